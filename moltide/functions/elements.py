"""Element data: atomic masses, covalent and van der Waals radii."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Standard atomic masses in u, by symbol in order of atomic number.
MASSES = """
    H 1.00794, He 4.002602, Li 6.941, Be 9.012182, B 10.811, C 12.0107, N 14.0067, O 15.9994, F 18.9984032,
    Ne 20.1797, Na 22.98976928, Mg 24.305, Al 26.9815386, Si 28.0855, P 30.973762, S 32.065, Cl 35.453, Ar 39.948,
    K 39.0983, Ca 40.078, Sc 44.955912, Ti 47.867, V 50.9415, Cr 51.9961, Mn 54.938045, Fe 55.845, Co 58.933195,
    Ni 58.6934, Cu 63.546, Zn 65.409, Ga 69.723, Ge 72.64, As 74.9216, Se 78.96, Br 79.904, Kr 83.798, Rb 85.4678,
    Sr 87.62, Y 88.90585, Zr 91.224, Nb 92.90638, Mo 95.94, Tc 98.9063, Ru 101.07, Rh 102.9055, Pd 106.42,
    Ag 107.8682, Cd 112.411, In 114.818, Sn 118.71, Sb 121.76, Te 127.6, I 126.90447, Xe 131.293, Cs 132.9054519,
    Ba 137.327, La 138.90547, Ce 140.116, Pr 140.90465, Nd 144.242, Pm 146.9151, Sm 150.36, Eu 151.964, Gd 157.25,
    Tb 158.92535, Dy 162.5, Ho 164.93032, Er 167.259, Tm 168.93421, Yb 173.04, Lu 174.967, Hf 178.49, Ta 180.9479,
    W 183.84, Re 186.207, Os 190.23, Ir 192.217, Pt 195.084, Au 196.966569, Hg 200.59, Tl 204.3833, Pb 207.2,
    Bi 208.9804, Po 208.9824, At 209.9871, Rn 222.0176, Fr 223.0197, Ra 226.0254, Ac 227.0278, Th 232.03806,
    Pa 231.03588, U 238.02891, Np 237.0482, Pu 244.0642, Am 243.0614, Cm 247.0703, Bk 247.0703, Cf 251.0796,
    Es 252.0829, Fm 257.0951, Md 258.0951, No 259.1009, Lr 262, Rf 267, Db 268, Sg 271, Bh 270, Hs 269, Mt 278,
    Ds 281, Rg 281, Cn 285, Nh 284, Fl 289, Mc 289, Lv 292, Ts 294, Og 294
"""

#: Covalent radii in angstrom; elements without one are left out.
COVALENT_RADII = """
    H 0.37, He 0.32, Li 1.34, Be 0.9, B 0.82, C 0.77, N 0.75, O 0.73, F 0.71, Ne 0.69, Na 1.54, Mg 1.3, Al 1.18,
    Si 1.11, P 1.06, S 1.02, Cl 0.99, Ar 0.97, K 1.96, Ca 1.74, Sc 1.44, Ti 1.36, V 1.25, Cr 1.27, Mn 1.39, Fe 1.25,
    Co 1.26, Ni 1.21, Cu 1.38, Zn 1.31, Ga 1.26, Ge 1.22, As 1.19, Se 1.16, Br 1.14, Kr 1.1, Rb 2.11, Sr 1.92,
    Y 1.62, Zr 1.48, Nb 1.37, Mo 1.45, Tc 1.56, Ru 1.26, Rh 1.35, Pd 1.31, Ag 1.53, Cd 1.48, In 1.44, Sn 1.41,
    Sb 1.38, Te 1.35, I 1.33, Xe 1.3, Cs 2.25, Ba 1.98, La 1.69, Lu 1.6, Hf 1.5, Ta 1.38, W 1.46, Re 1.59, Os 1.28,
    Ir 1.37, Pt 1.28, Au 1.44, Hg 1.49, Tl 1.48, Pb 1.47, Bi 1.46, Rn 1.45
"""

#: Van der Waals radii in angstrom; elements without one are left out.
VDW_RADII = """
    H 1.2, He 1.4, Li 1.82, C 1.7, N 1.55, O 1.52, F 1.47, Ne 1.54, Na 2.27, Mg 1.73, Si 2.1, P 1.8, S 1.8, Cl 1.75,
    Ar 1.88, K 2.75, Ni 1.63, Cu 1.4, Zn 1.39, Ga 1.87, As 1.85, Se 1.9, Br 1.85, Kr 2.02, Pd 1.63, Ag 1.72, Cd 1.58,
    In 1.93, Sn 2.17, Te 2.06, I 1.98, Xe 2.16, Pt 1.75, Au 1.66, Hg 1.55, Tl 1.96, Pb 2.02, U 1.86
"""


def _read(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in (p.split() for p in text.split(","))}


MASS, R_COV, R_VDW = _read(MASSES), _read(COVALENT_RADII), _read(VDW_RADII)


def elements(spark: SparkSession) -> DataFrame:
    """(symbol, mass, r_cov, r_vdw): 118 rows, radii null where none is tabulated."""
    return spark.createDataFrame([(s, m, R_COV.get(s), R_VDW.get(s)) for s, m in MASS.items()], "symbol string, mass double, r_cov double, r_vdw double")


def radius(symbol: str, kind: str) -> float:
    """Covalent ('coval') or van der Waals ('vdw') radius; ValueError names an element without one."""
    table = {"coval": R_COV, "vdw": R_VDW}[kind]
    if symbol not in table:
        raise ValueError(f"no {kind} radius for element {symbol!r}")
    return table[symbol]
