"""Catalogue of spectral indexes."""

from __future__ import annotations

# Name; band family; equation over R, G, B, RE, NIR, SWIR, TIR, wavelengths (NNNnm) and h, s, b.
TABLE = """
a; CIELab; 0.55*( (R - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.2126))
b*; CIELab; 0.55*( (B - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.0722))
b*-a; CIELab; (0.55*( (B - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.0722))) - (0.55*( (R - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.2126)))
L*; CIELab; (0.2126 * R + 0.7152 * G + 0.0722 * B)
L*-a; CIELab; ((0.2126 * R + 0.7152 * G + 0.0722 * B)) - (0.55*( (R - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.2126)))
L*-b; CIELab; ((0.2126 * R + 0.7152 * G + 0.0722 * B)) - (0.55*( (B - (0.2126 * R + 0.7152 * G + 0.0722 * B)) / (1.0 - 0.0722)))
DGCI; HSB; ((h - 60)/60 + (1 - s/100) + (1 - b/100)) / 3
ARI; MULTI; (1 / G) - (1 / RE)
ARVI; MULTI; (NIR - (R - 0.1*(R-B))) / (NIR + (R - 0.1*(R-B)))
BAI; MULTI; 1/((0.1 - R)^2 + (0.06 - NIR)^2)
BWDRVI; MULTI; (0.1*NIR-B)/(0.1*NIR+B)
CCCI; MULTI; ((NIR-R)/(NIR+R))/((NIR-R)/(NIR+R))
CIG; MULTI; (NIR/G)-1
CIRE; MULTI; (NIR/RE)-1
CVI; MULTI; NIR * (R/(G*G))
EVI; MULTI; 2.5*(NIR-R)/(NIR+6*R-7.5*B+1)
GARI; MULTI; (NIR - (1.7 * (B-R))) / (NIR + (1.7 * (B-R)))
GDVI; MULTI; NIR-G
GEMI; MULTI; (2*(NIR*NIR-R*R)+1.5*NIR+0.5*R)/(NIR+R+0.5)*(1-0.25*(2*(NIR*NIR-R*R)+1.5*NIR+0.5*R)/(NIR+R+0.5))-((R-0.125)/(1-R))
GNDVI; MULTI; (NIR - G) / (NIR + G)
GOSAVI; MULTI; (NIR-G)/(NIR+G+0.16)
GRVI; MULTI; NIR / G
GSAVI; MULTI; ((NIR-G)/(NIR+G+0.5))*(1+0.5)
IPVI; MULTI; NIR / (NIR + R)
LAI; MULTI; 3.368 * (2.5*(NIR-R)/(NIR+6*R-7.5*B+1)) - 0.118
MCARI1; MULTI; 1.2*((2.5*(NIR-R))-(1.3*(NIR-G)))
MCARI2; MULTI; (1.2*(2.5*(NIR-R)-1.3*(NIR-G))/sqrt((2*NIR+1)^2-(6*NIR-5*sqrt(R))-0.5))
MSAVI; MULTI; (1/2)*(2*(NIR+1)-sqrt((2*NIR+1)*2-8*(NIR-R)))
MSAVI2; MULTI; (2 * NIR + 1 - sqrt((2 * NIR + 1)^2 - 8 * (NIR - R) )) / 2
MSR; MULTI; (NIR / R - 1) / (sqrt(NIR / R) + 1)
NDMI; MULTI; (NIR - SWIR) / (NIR + SWIR)
NDRE; MULTI; (NIR-RE)/(NIR+RE)
NDVI; MULTI; (NIR - R) / (NIR + R)
NDWI; MULTI; (G-NIR)/(G+NIR)
NIR; MULTI; NIR
NLI; MULTI; (NIR ^2 - R) / (NIR ^2 + R)
OSAVI; MULTI; (NIR-R)/(NIR+R+0.16)
PNDVI; MULTI; ((NIR-(G+R+B))/(NIR+(G+R+B)))
PSRI; MULTI; (R-G)/RE
RDVI; MULTI; (NIR - R) / (sqrt(NIR + R))
RE; MULTI; RE
REDVI; MULTI; NIR-RE
RESR; MULTI; NIR/RE
RVI; MULTI; R/NIR
SAVI2; MULTI; ((NIR-R) / (NIR + R + 0.5) * 1 + 0.5)
SWIR; MULTI; SWIR
TCARI; MULTI; 3 * ((RE - R) - 0.2 * (RE - G) * (RE/R))
TDVI; MULTI; 1.5 * ((NIR - R) / (sqrt(NIR ^2 + R + 0.5)))
TIR; MULTI; TIR
TSAVI; MULTI; (2*((NIR-2)*(R-1)))/(R+2*(NIR-1)+0.5*(1+2*2))
TVI; MULTI; sqrt((NIR - R) / (NIR + R) + 0.5)
VARIRE; MULTI; (RE - 1.7 * R + 0.7 * B) / (RE + 2.3 * R - 1.3 * B)
VIG; MULTI; (G-R)/(G+R)
VIN; MULTI; NIR/R
VIRE; MULTI; (RE-R)/(RE+R)
WDRVI; MULTI; (0.2 * NIR - R) / (0.2 * NIR + R)
WSI; MULTI; 5*(NIR - R) / (NIR + R) - (RE-NIR) / (RE+NIR)
B; RGB; B
BGI; RGB; B/G
BI; RGB; sqrt((R^2 + G^2 + B^2) / 3)
BI2; RGB; sqrt((R^2 + G^2 + B^2) / 3)
CI; RGB; ((R - B) / R)
CIVE; RGB; 0.441*R - 0.881*G + 0.385*B + 18.78745
EGVI; RGB; 2*G-R-B
ERVI; RGB; ((1.4*R)- G)
G; RGB; G
GB; RGB; G / B
GD; RGB; G - (R+B) / 2
GLAI; RGB; (25 * (G - R) / (G + R - B) + 1.25)
GLI; RGB; (2*G - R - B)/(2*G + R + B)
GR; RGB; G / R
GRAY; RGB; 0.299 * R + 0.587 * G + 0.114 * B
GRAY2; RGB; ((R^2.2 + (1.5 * G)^2.2 + (0.6 * B)^2.2) / (1 + 1.5^2.2 + 0.6^2.2))^(1/2.2)
HI; RGB; (2*R-G-B)/(G-B)
HUE; RGB; atan(2*(B-G-R)/30.5*(G-R))
HUE2; RGB; atan(2*(R-G-R)/30.5*(G-B))
I; RGB; R + G + B
L; RGB; (R + G + B) / 3
MGVRI; RGB; (G^2-R^2)/(G^2+R^2)
NB; RGB; B / (R + G + B)
NG; RGB; G / (R + G + B)
NGBDI; RGB; (G-B)/(G+B)
NGRDI; RGB; (G-R)/(G+R)
NR; RGB; R / (R + G + B)
R; RGB; R
RB; RGB; R / B
RI; RGB; (R^2 / (B * G^3))
S; RGB; ((R + G + B) - 3 * B) / (R + G + B)
SAVI; RGB; (1 + 0.5)*(G-R)/(G+R+0.5)
SCI; RGB; (R - G) / (R + G)
SHP; RGB; (2 * (R - G - B) / (G - B))
SI; RGB; (R-B)/(R+B)
VARI; RGB; (G-R)/(G+R-B)
BCC; RGB; B/(R+G+B)
BRVI; RGB; (B-R)/(B+R)
GCC; RGB; G/(R+G+B)
GRVI2; RGB; (G-R)/(G+R)
IPCA; RGB; 0.994*abs(R-B) + 0.961*abs(G-B) + 0.914*abs(G-R)
MVARI; RGB; (G - B)/(G + R - B)
NDI; RGB; 128*((G - R)/(G + R) + 1)
RCC; RGB; R/(R + G + B)
RGBVI; RGB; (G**2 - (B * R))/(G**2 + (B * R))
TGI; RGB; G - 0.39*R - 0.61*B
VEG; RGB; G/(R^0.667 * B^0.334)
vNDVI; RGB; 0.5268 * (R^-0.1294*G^0.3389 * B^-0.3118)
WI; RGB; (G - B)/(R - G)
RENDVI; HYP; (750nm - 711nm) / (750nm + 711nm)
VREI; HYP; 734nm / 722nm
VREI2; HYP; (734nm - 750nm) / (711nm + 722nm)
MTVI; HYP; 1.2 * (1.2 * (799nm - 549nm) - 2.5*(669nm - 549nm))
RESVI; HYP; (722nm + 750nm) / 2 - 734nm
mNDVI; HYP; (750nm - 699nm) / (750nm + 699nm)
PRI; HYP; (535nm - 570nm) / (535nm + 570nm)
GREENNESS; HYP; 549nm / 669nm
CHL; HYP; 764nm / 549nm - 1
"""

CATALOGUE = [tuple(part.strip() for part in line.split(";")) for line in TABLE.strip().splitlines()]
FORMULAS = {name: formula for name, _, formula in CATALOGUE}


def names(family: str | None = None) -> list[str]:
    """Names of all indexes, or of those of a family: RGB, MULTI, HYP, CIELab, HSB."""
    return [name for name, band, _ in CATALOGUE if family is None or band == family]
