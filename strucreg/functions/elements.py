"""Chemical elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Symbol, atomic number, standard atomic mass.
ELEMENTS = [
    ("H", 1, 1.008), ("He", 2, 4.003), ("Li", 3, 6.941), ("Be", 4, 9.012), ("B", 5, 10.812), ("C", 6, 12.011),
    ("N", 7, 14.007), ("O", 8, 15.999), ("F", 9, 18.998), ("Ne", 10, 20.180), ("Na", 11, 22.990), ("Mg", 12, 24.305),
    ("Al", 13, 26.982), ("Si", 14, 28.086), ("P", 15, 30.974), ("S", 16, 32.067), ("Cl", 17, 35.453), ("Ar", 18, 39.948),
    ("K", 19, 39.098), ("Ca", 20, 40.078), ("Sc", 21, 44.956), ("Ti", 22, 47.867), ("V", 23, 50.942), ("Cr", 24, 51.996),
    ("Mn", 25, 54.938), ("Fe", 26, 55.845), ("Co", 27, 58.933), ("Ni", 28, 58.693), ("Cu", 29, 63.546), ("Zn", 30, 65.39),
    ("Ga", 31, 69.723), ("Ge", 32, 72.61), ("As", 33, 74.922), ("Se", 34, 78.96), ("Br", 35, 79.904), ("Kr", 36, 83.80),
    ("Rb", 37, 85.468), ("Sr", 38, 87.62), ("Y", 39, 88.906), ("Zr", 40, 91.224), ("Nb", 41, 92.906), ("Mo", 42, 95.94), ("Tc", 43, 98.0),
    ("Ru", 44, 101.07), ("Rh", 45, 102.906), ("Pd", 46, 106.42), ("Ag", 47, 107.868), ("Cd", 48, 112.412), ("In", 49, 114.818),
    ("Sn", 50, 118.711), ("Sb", 51, 121.760), ("Te", 52, 127.60), ("I", 53, 126.904), ("Xe", 54, 131.29), ("Cs", 55, 132.905),
    ("Ba", 56, 137.328), ("La", 57, 138.906), ("Ce", 58, 140.116), ("Pr", 59, 140.908), ("Nd", 60, 144.24), ("Pm", 61, 145.0),
    ("Sm", 62, 150.36), ("Eu", 63, 151.964), ("Gd", 64, 157.25), ("Tb", 65, 158.925), ("Dy", 66, 162.50), ("Ho", 67, 164.930),
    ("Er", 68, 167.26), ("Tm", 69, 168.934), ("Yb", 70, 173.04), ("Lu", 71, 174.967), ("Hf", 72, 178.49), ("Ta", 73, 180.948), ("W", 74, 183.84), ("Re", 75, 186.207), ("Os", 76, 190.23), ("Ir", 77, 192.217), ("Pt", 78, 195.078),
    ("Au", 79, 196.967), ("Hg", 80, 200.59), ("Tl", 81, 204.383), ("Pb", 82, 207.2), ("Bi", 83, 208.980),
    ("Po", 84, 209.0), ("At", 85, 210.0), ("Rn", 86, 222.0), ("Fr", 87, 223.0), ("Ra", 88, 226.0), ("Ac", 89, 227.0),
    ("Th", 90, 232.038), ("Pa", 91, 231.036), ("U", 92, 238.029), ("Np", 93, 237.0), ("Pu", 94, 244.0), ("Am", 95, 243.0),
    ("Cm", 96, 247.0), ("Bk", 97, 247.0), ("Cf", 98, 251.0), ("Es", 99, 252.0), ("Fm", 100, 257.0), ("Md", 101, 258.0),
    ("No", 102, 259.0), ("Lr", 103, 262.0),
]

# Bonds of a neutral atom that are filled up with hydrogen, and the most an atom may have.
DEFAULT_VALENCE = {
    "B": 3, "C": 4, "N": 3, "O": 2, "F": 1, "Si": 4, "P": 3, "S": 2, "Cl": 1, "Br": 1, "I": 1,
}
MAX_VALENCE = {
    "H": 1, "B": 3, "C": 4, "N": 3, "O": 2, "F": 1, "Si": 4, "P": 5, "S": 6, "Cl": 1, "Br": 1, "I": 5,
}
# How a formal charge shifts both numbers; other elements gain a bond per positive charge.
LOSES_BOND_WHEN_CHARGED = ("C", "Si", "H")

SCHEMA = "symbol string, atomic_num int, mass double, default_valence int, max_valence int"


def element_table(spark: SparkSession) -> DataFrame:
    rows = [(s, n, m, DEFAULT_VALENCE.get(s), MAX_VALENCE.get(s)) for s, n, m in ELEMENTS]
    return spark.createDataFrame(rows, SCHEMA)
