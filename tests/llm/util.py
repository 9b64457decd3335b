def rows_of(df):
    return len(df.collect())
