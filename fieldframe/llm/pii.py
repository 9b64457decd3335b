"""Personal data replaced by surrogates.

Entities (e-mail addresses, phone numbers, card and account numbers, IP addresses, national ids, names after a title or a
naming phrase) get keyed replacements of the same type, script, gender and format. What identifies an entity is its
normal form (letter case and separators aside), so all its mentions get one surrogate; a name found once is looked for in
the whole text. Numbers and addresses go through a
keyed permutation of all values of their format; names are composed of syllables of their script with an ending of their
gender. A global check over the distinct entities rejects surrogates that two entities share or that are themselves
entities of the corpus, and these are drawn anew until none is left.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: For tests and examples; a production run passes its own.
KEY = b"fieldframe surrogate key"
EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.%+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.ASCII)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
CARD = re.compile(r"(?<![\w.-])(?:\d{4}([\x20-])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\w]|[.-]\d)", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
PHONE = re.compile(r"(?<![\w+(])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]\d{3,4}(?![\w]|[.-]\d)|(?<![\w+])\+\d{8,14}(?!\w)", re.ASCII)
DIGIT = re.compile("[0-9]")
# Fixed values.
MALE_TITLES = "Mr Mister Sir Herr Monsieur Señor Sr Господин Κύριος".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Госпожа Κυρία".split()
OTHER_TITLES = "Dr Prof Professor Doktor Docteur Doctor".split()
PHRASES = ("my name is", "name:", "je m'appelle", "ich heiße", "mein name ist", "me llamo", "mi nombre es", "меня зовут")
MALE_NAMES = frozenset("james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul peter hans karl jean pierre louis jose carlos juan luis pedro иван пётр".split())
FEMALE_NAMES = frozenset("mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria emma laura julia sophie marie claire carmen lucia ana heidi greta мария анна ольга".split())
NAME_WORD = r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*"
TITLED = re.compile(rf"(?<!\w)({'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.?\x20+({NAME_WORD})(?:\x20+({NAME_WORD}))?")
SAID = re.compile(rf"(?<!\w)(?i:{'|'.join(PHRASES)})\x20*({NAME_WORD})(?:\x20+({NAME_WORD}))?")
TITLES = frozenset(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
TITLE_WORDS = tuple(t + e for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES for e in (" ", "."))
#: Per script: consonants, vowels and the endings of male, female and other given names and of surnames.
SCRIPTS = {
    "LATIN": ("bdfgklmnprstvz", "aeiou", ("on", "a", "el", "er")),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", ("ан", "а", "ель", "ин")),
    "GREEK": ("βγδζκλμνπρστ", "αεηιο", ("ος", "α", "ις", "ης")),
}
#: Other scripts: first letter and number of letters in a row that surrogates are drawn from.
RANGES = {"CJK": (0x4E00, 4096), "HANGUL": (0xAC00, 4096), "HIRAGANA": (0x3042, 80), "KATAKANA": (0x30A2, 80), "ARABIC": (0x0628, 18), "HEBREW": (0x05D0, 26), "DEVANAGARI": (0x0915, 36), "THAI": (0x0E01, 40), "ARMENIAN": (0x0561, 36), "GEORGIAN": (0x10D0, 32)}


def digest(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permuted(key: bytes, tweak: str, x: int, n: int) -> int:
    """A keyed permutation of 0 .. n - 1: eight Feistel rounds over enough bits, repeated until the value is below n."""
    bits = max((n - 1).bit_length(), 2)
    low = bits // 2
    high = bits - low
    while True:
        a, b, wide, narrow = x >> low, x & ((1 << low) - 1), high, low
        for r in range(8):
            a, b = b, a ^ (digest(key, tweak, n, r, b) & ((1 << wide) - 1))
            wide, narrow = narrow, wide
        x = (a << low) | b if wide == high else (a << high) | b
        if x < n:
            return x


def reshaped(key: bytes, tweak: str, text: str) -> str:
    """Another text of the same pattern: small letters, capitals and digits (ASCII) change, all else stays. One to one
    among the texts of a pattern; letters beyond ASCII count as small or capital ones of ASCII."""
    text = "".join(c if c.isascii() or not c.isalnum() else "x" if not c.isupper() else "X" for c in text)
    sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    bases = [ord("0") if c.isdigit() else ord("A") if c.isupper() else ord("a") for c in text]
    x, n = 0, 1
    for c, size, base in zip(text, sizes, bases, strict=True):
        if size > 1:
            x, n = x * size + ord(c) - base, n * size
    if n < 2:
        return text
    pattern = "".join("0" if s == 10 else ("A" if b == 65 else "a") if s == 26 else c for c, s, b in zip(text, sizes, bases, strict=True))
    x = permuted(key, f"{tweak}:{pattern}", x, n)
    out = []
    for c, size, base in zip(reversed(text), reversed(sizes), reversed(bases), strict=True):
        if size > 1:
            x, k = divmod(x, size)
            c = chr(base + k)
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split()[0].split("-")[0]


def coined(key: bytes, kind: str, word: str, attempt: int) -> str:
    """A name of the word's script, with an ending for its kind (given_m, given_f, given, surname)."""
    h = digest(key, kind, word, attempt)
    at = script(word)
    if at in SCRIPTS:
        consonants, vowels, endings = SCRIPTS[at]
        out = []
        for _ in range(2 + min(len(word), 8) // 4 + attempt // 2):
            h, c = divmod(h, len(consonants))
            h, v = divmod(h, len(vowels))
            out += [consonants[c], vowels[v]]
        out.append(consonants[h % len(consonants)] + endings[("given_m", "given_f", "given", "surname").index(kind)])
        return "".join(out)
    first, n = RANGES.get(at, RANGES["CJK"])
    out = []
    for _ in range(max(len(word), 1) + attempt // 2):
        h, c = divmod(h, n)
        out.append(chr(first + c))
    return "".join(out)


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """The surrogate's normal form."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        return f"{reshaped(key, tweak, local)}@{reshaped(key, 'domain', domain)}.example"
    if kind == "ip":
        parts = [int(p) for p in normal.split(".")]
        x = permuted(key, tweak, int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card" and luhn(normal[:-1]) == int(normal[-1]):
        body = reshaped(key, tweak + ":luhn", normal[:-1])
        return body + str(luhn(body))
    if kind == "iban":
        return normal[:2] + reshaped(key, tweak, normal[2:])
    if kind == "phone":
        code, _, rest = normal.rpartition("|")
        return f"{code}|{reshaped(key, tweak, rest)}"
    if kind in ("card", "ssn"):
        return reshaped(key, tweak, normal)
    return coined(key, kind, normal, attempt)


def normal_form(kind: str, text: str) -> str:
    if kind == "phone":
        m = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        code, rest = (m[1], text[m.end() :]) if m else (text[1:3], text[3:]) if text[0] == "+" else ("", text)
        return f"{code}|{re.sub(r'[^0-9]', '', rest)}"
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", text)
    return text if kind in ("ip", "ssn") else text.lower()


def render(kind: str, text: str, new: str) -> str:
    """The surrogate's normal form written as the mention is: its separators and its case."""
    if kind == "phone":
        code, _, rest = new.rpartition("|")
        digits = iter(code + rest)
        return "".join(next(digits) if c.isdigit() else c for c in text)
    if kind in ("card", "iban"):
        chars = iter(new)
        return "".join(c if c in " -" else next(chars) for c in text)
    if kind in ("ip", "ssn"):
        return new
    if text.isupper() and len(text) > 1:
        return new.upper()
    return new[0].upper() + new[1:] if text[0].isupper() else new


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), not overlapping, by start; where kinds overlap, the one that comes first in the code wins.

    A name found after a title or phrase is then looked for in the whole text as a whole word: as it was written, with one
    capital or in capitals, since in small letters many names are common words. All mentions of a name in a text have
    one kind. Titles and single letters of alphabets with capitals are not looked for.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        for kind, rule in (("ip", IPV4), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            found += [(*m.span(), kind) for m in rule.finditer(text)]
    if any(t in text for t in TITLE_WORDS):
        for m in TITLED.finditer(text):
            gender = "_m" if m[1] in MALE_TITLES else "_f" if m[1] in FEMALE_TITLES else ""
            found += names(m, 2, gender)
    low = text.lower()
    if any(p in low for p in PHRASES):
        for m in SAID.finditer(text):
            found += names(m, 1, None)
    if any(kind.startswith(("given", "surname")) for _, _, kind in found):
        found = agreed(text, found)
        found += further(text, found)
    # Spans taken so far, by start; a new one can only meet its two neighbours there.
    out: list[tuple[int, int, str]] = []
    for s, e, kind in found:
        at = bisect(out, (s, e, ""))
        if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, (s, e, kind))
    return out


def agreed(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same with one kind for each name of the text: the first gender that any of its mentions tells, else the first
    mention's kind, so that a person keeps one name however they are addressed."""
    kinds: dict[str, str] = {}
    for s, e, kind in sorted(found):
        if kind.startswith(("given", "surname")):
            low = text[s:e].lower()
            if low not in kinds or "_" in kind and "_" not in kinds[low] and kinds[low] != "surname":
                kinds[low] = kind
    return [(s, e, kinds[text[s:e].lower()] if kind.startswith(("given", "surname")) else kind) for s, e, kind in found]


def further(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """All mentions of the names in ``found``; of two names that begin alike, the longer one."""
    kinds: dict[str, str] = {}
    for s, e, kind in sorted(found):
        if kind.startswith(("given", "surname")):
            kinds.setdefault(text[s:e].lower(), kind)
    forms = {}
    for s, e, kind in found:
        name = text[s:e]
        if (low := name.lower()) in kinds and name not in TITLES and (len(name) > 1 or low == name.upper()):
            forms |= dict.fromkeys((name, low[0].upper() + low[1:], name.upper()), kinds[low])
    if not forms:
        return []
    rule = "|".join(map(re.escape, sorted(forms, key=lambda w: (-len(w), w))))
    return [(*m.span(), forms[m[0]]) for m in re.finditer(rf"(?<!\w)(?:{rule})(?!\w)", text)]


def names(m: re.Match, at: int, gender: str | None) -> list[tuple[int, int, str]]:
    """Two words after a title or phrase are given name and surname; one is a surname after a title, else a given name."""
    first, last = own(m, at), own(m, at + 1)
    name = m.string[slice(*first)].lower()
    if gender in (None, ""):
        known = "_m" if name in MALE_NAMES else "_f" if name in FEMALE_NAMES else ""
    else:
        known = gender
    if m[at + 1] is None:
        return [(*first, "given" + known if gender is None else "surname")]
    return [(*first, "given" + known), (*last, "surname")]


def own(m: re.Match, at: int) -> tuple[int, int]:
    """The place of a name without a possessive 's."""
    s, e = m.span(at)
    return (s, e - 2) if m[at] and len(m[at]) > 3 and m[at].endswith(("'s", "’s")) else (s, e)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, normal): the distinct entities of all texts."""

    def run(batches):
        for b in batches:
            seen = dict.fromkeys((k, normal_form(k, t[s:e])) for t in b.column(0).to_pylist() if t for s, e, k in find(t))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([n for _, n in seen])], ["kind", "normal"])

    return docs.select("text").mapInArrow(run, "kind string, normal string").distinct()


def drawn(df: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches):
        for b in batches:
            new = [surrogate(key, k, n, attempt) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], ["kind", "normal", "new"])

    return df.select("kind", "normal").mapInArrow(run, "kind string, normal string, new string")


#: Draws after which a surrogate may be another text's real value (formats of few values, most of which the corpus has),
#: and after which the job fails, since the entities of a format have used up nearly all its values.
STRICT, DRAWS = 16, 64


def redrawn(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt): the entities whose surrogate is not their first draw.

    A draw is refused if it is itself an entity of the corpus (for the first STRICT draws), was given before, or another
    entity of a smaller normal form draws it too. Given names of any gender share one space.
    """
    spark = docs.sparkSession
    family = lambda c: F.regexp_replace(c, "_.$", "")
    real = common.save(entities(docs))
    taken = real.select(family(F.col("kind")).alias("__family"), F.col("normal").alias("__new")).distinct()
    waiting, later, attempt, given = real, None, 0, None
    while attempt < DRAWS:
        if attempt == STRICT:
            taken = given
        draws = common.save(drawn(waiting, key, attempt).withColumn("family", family(F.col("kind"))))
        first = draws.groupBy("family", "new").agg(F.min(F.struct("normal", "kind")).alias("winner"))
        free = first.join(taken, (F.col("family") == F.col("__family")) & (F.col("new") == F.col("__new")), "left_anti")
        won = common.save(free.select(F.col("winner.kind").alias("kind"), F.col("winner.normal").alias("normal"), "family", "new"))
        if attempt:
            part = won.select("kind", "normal", F.lit(attempt).alias("attempt"))
            later = part if later is None else later.union(part)
        waiting = common.save(draws.select("kind", "normal").join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        if waiting.isEmpty():
            return later if later is not None else spark.createDataFrame([], "kind string, normal string, attempt int")
        new = won.select(F.col("family").alias("__family"), F.col("new").alias("__new"))
        taken, given = taken.union(new), new if given is None else given.union(new)
        attempt += 1
    few = ", ".join(f"{r['count']} of kind {r.kind}" for r in waiting.groupBy("kind").count().collect())
    raise ValueError(f"no surrogates are left for some entities: {few}")


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with the entities in ``text`` replaced, ``n_chars`` (where there is one) counted anew, and further columns
    n_entities and entities (kind:mentions, by kind, comma-joined); where docs has columns of these names, the new ones are
    called _n_entities and _entities.

    Null texts stay null, empty ones empty; rows with null and repeated ids stay as they are, and equal texts get equal
    surrogates; a text of any length is read whole; an empty table gives an empty result.
    """
    later = common.save(redrawn(docs.select("doc_id", "text"), key))
    row = F.xxhash64(docs["doc_id"], docs["text"])
    mark, owner = common.unused(docs, "drawn"), common.unused(docs, "row")
    more = [common.unused(docs, "n_entities"), common.unused(docs, "entities")]

    def mentioned(batches):
        for b in batches:
            pairs = list(dict.fromkeys((r, k, normal_form(k, t[s:e])) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for s, e, k in find(t)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.string())], ["__row", "kind", "normal"])

    if later.isEmpty():
        joined = docs.withColumn(mark, F.lit(None).cast("array<struct<kind: string, normal: string, attempt: int>>"))
    else:
        mentions = docs.select(row.alias("__row"), "text").mapInArrow(mentioned, "__row long, kind string, normal string")
        per_row = common.save(mentions.join(later, ["kind", "normal"]).groupBy(F.col("__row").alias(owner)).agg(F.collect_set(F.struct("kind", "normal", "attempt")).alias(mark)))
        joined = docs.join(per_row, row == F.col(owner), "left").select(*[docs[c] for c in docs.columns], mark)
    kept = docs.columns
    at = kept.index("text")
    size = kept.index("n_chars") if "n_chars" in kept else None

    def run(batches):
        cache: dict[tuple, str] = {}
        for b in batches:
            old = b.column(at).to_pylist()
            new, totals, said = [], [], []
            for text, drawn_ in zip(old, b.column(len(kept)).to_pylist(), strict=True):
                attempts = {(d["kind"], d["normal"]): d["attempt"] for d in drawn_ or ()}
                out, pos, counts = [], 0, Counter()
                for s, e, kind in find(text) if text else ():
                    normal = normal_form(kind, text[s:e])
                    full = (kind, normal, attempts.get((kind, normal), 0))
                    if full not in cache:
                        if len(cache) > 50_000:
                            cache.clear()
                        cache[full] = surrogate(key, *full)
                    out += [text[pos:s], render(kind, text[s:e], cache[full])]
                    pos = e
                    counts[kind.split("_")[0]] += 1
                new.append("".join([*out, text[pos:]]) if out else text)
                totals.append(sum(counts.values()))
                said.append(",".join(f"{k}:{n}" for k, n in sorted(counts.items())))
            columns = list(b.columns)[: len(kept)]
            columns[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([n if x == y else len(y) for n, x, y in zip(columns[size].to_pylist(), old, new, strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(said, pa.string())], [*kept, *more])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kinds}, `{more[0]}` long, `{more[1]}` string")


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
