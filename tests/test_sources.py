"""Structure files, tables, scoring requests."""

import pytest
from pyspark.sql import functions as F

from strucreg.operators import attach, graph
from strucreg.operators.linear import LinearModel
from strucreg.plans import scoring
from strucreg.sources import structures, tables

XYZ = {
    "plain": "2\ncomment\nH 0.0 0.0 0.1\n O  1 2 3e-1\n",
    "windows": "2\r\nc\r\nC 1 2 3\r\nN 4 5 6\r\n",
    "mixed": "9\nH 9 9 9\nH 1 2\n\nH 1 2 3 4\nTi\t-1.5 .5 +2.\n",
    "bad": "1\nc\nC 1 x 3\nC 1 2 3\n",
    "suffix": "1\nc\nC 1d 2 3\n",
    "empty": "0\nnothing\n",
    "returns": "2\rc\rC 1 2 3\rN 4 5 6\r",
    "c#d e[1] j%k f%20g+h": "1\nc\nC 1 2 3\n",
}


def _write(folder, files, suffix):
    for name, text in files.items():
        (folder / f"{name}.{suffix}").write_bytes(text.encode())


@pytest.mark.parametrize("split", [False, True])
def test_xyz_files(spark, tmp_path, split):
    """Whole files, and files read in pieces of a few bytes, give the same atoms."""
    many = "".join(f"C {i} {i / 4} -{i}\n" + ("junk line here\n" if i % 3 == 0 else "") for i in range(200))
    _write(tmp_path, {**XYZ, "many": "200\nc\n" + many}, "xyz")
    (tmp_path / "notes.txt").write_text("1\nc\nC 1 2 3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        atoms = structures.read_xyz(spark, str(tmp_path), whole_file_bytes=0 if split else 10**6)
        rows = {(r["name"], r["atom_idx"]): (r["symbol"], r["x"], r["y"], r["z"]) for r in atoms.filter("valid").collect()}
        good, bad = structures.quarantine_structures(atoms)
        assert {tuple(r) for r in bad.collect()} == {("bad", 1), ("suffix", 1)}
        assert {r["name"] for r in good.select("name").distinct().collect()} == {"plain", "windows", "mixed", "many", "returns", "c#d e[1] j%k f%20g+h"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows["plain", 0] == ("H", 0.0, 0.0, 0.1) and rows["plain", 1] == ("O", 1.0, 2.0, 0.3)
    assert rows["windows", 1] == rows["returns", 1] == ("N", 4.0, 5.0, 6.0)
    assert [k for k in rows if k[0] == "mixed"] == [("mixed", 0)] and rows["mixed", 0] == ("Ti", -1.5, 0.5, 2.0)
    assert [rows["many", i][1] for i in range(200)] == [float(i) for i in range(200)]


def _record(title, atoms, bonds, extra=(), counts=None):
    n, m = counts or (len(atoms), len(bonds))
    lines = [title, "  x", "", f"{n:3d}{m:3d}  0  0"]
    lines += [f"{x:10.4f}{y:10.4f}{z:10.4f} {s:<3s} 0  0" for s, x, y, z in atoms]
    lines += [f"{a:3d}{b:3d}{o:3d}  0" for a, b, o in bonds]
    return "\n".join([*lines, *extra, "M  END", "$$$$\n"])


CO = [("C", 0, 0, 0), ("O", 1.25, 0, 0)]
SDF = {
    "two": _record("first", CO, [(1, 2, 2)]) + _record("second", CO[:1], []),
    "charged": _record("", [("N", 0, 0, 0), ("O", 1, 0, 0), ("C", -1.5, 2, 0)], [(1, 2, 1), (1, 3, 4)], ["M  CHG  2   1   1   2  -1"]),
    "loose": _record("t", CO, [(1, 5, 1)]),
    "short": "t\n\n\n  5  1\n    0.0000    0.0000    0.0000 C   0\n$$$$\n",
    "later": _record("t", CO, [(1, 2, 1)], counts=(99, 1)) + _record("ok", CO, [(1, 2, 1)]),
    "windows": _record("w", CO, [(1, 2, 1)]).replace("\n", "\r\n"),
    "returns": _record("r", CO, [(1, 2, 1)]).replace("\n", "\r"),
    "v3000": "t\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  END\n$$$$\n" + _record("ok", CO, [(1, 2, 1)]),
    "coded": _record("t", CO, []).replace(" O   0  0", " O   0  3").replace(" C   0  0", " C   0  5"),
    "long": _record("t", [("N", 0, 0, 0)] * 200, [], ["M  CHG200" + "".join(f" {i:3d}   1" for i in range(1, 201))]),
    "none": "\n",
}


@pytest.mark.parametrize("split", [False, True])
def test_sdf_files(spark, tmp_path, split):
    _write(tmp_path, SDF, "sdf")
    _write(tmp_path, {"other": SDF["two"]}, "mol")
    parsed = structures.parse_sdf(structures.read_sdf_records(spark, str(tmp_path), 0 if split else 10**6))
    reasons = {(r["name"], r["record_no"]): r["reason"] for r in parsed.collect()}
    assert reasons == {
        ("two", 0): None, ("two", 1): None, ("charged", 0): None, ("windows", 0): None,
        ("returns", 0): None, ("v3000", 0): "unreadable counts", ("v3000", 1): None, ("coded", 0): None, ("long", 0): None,
        ("loose", 0): "bond to a missing atom", ("short", 0): "truncated", ("later", 0): "truncated", ("later", 1): None,
    }
    first = structures.first_record(parsed)
    assert {r["name"]: r["n_atoms"] for r in first.collect()} == {
        "two": 2, "charged": 3, "windows": 2, "later": 2, "returns": 2, "v3000": 2, "coded": 2, "long": 200,
    }
    assert {r["name"]: r["n_atoms"] for r in structures.first_record(parsed, "last").collect()}["two"] == 1
    atoms = {(r["name"], r["atom_idx"]): r for r in structures.molecule_atoms(first).collect()}
    assert [atoms["charged", i]["charge"] for i in range(3)] == [1, -1, 0]
    assert [atoms["coded", i]["charge"] for i in range(2)] == [-1, 1] and all(atoms["long", i]["charge"] == 1 for i in range(200))
    assert (atoms["two", 1]["symbol"], atoms["two", 1]["x"], atoms["charged", 2]["y"]) == ("O", 1.25, 2.0)
    bonds = {tuple(r) for r in structures.molecule_bonds(first).filter(F.col("name") == "charged").collect()}
    assert bonds == {("charged", 0, 1, 1), ("charged", 0, 2, 4)}


def _extended(atoms, bonds, numbers=None, counts=None, wrap=False, end="\n"):
    """atoms: (symbol, x, y, z, more); bonds: (order, first, second) by atom number."""
    numbers = numbers or range(1, len(atoms) + 1)
    n, m = counts or (len(atoms), len(bonds))
    lines = ["t", "  x", "", "  0  0  0     0  0            999 V3000", "M  V30 BEGIN CTAB", f"M  V30 COUNTS {n} {m} 0 0 0", "M  V30 BEGIN ATOM"]
    for i, (s, x, y, z, more) in zip(numbers, atoms):
        lines += [f"M  V30 {i} {s} {x} -", f"M  V30 {y}   {z} 0 {more}"] if wrap else [f"M  V30 {i} {s} {x} {y} {z} 0 {more}".rstrip()]
    lines += ["M  V30 END ATOM"]
    if bonds:
        lines += ["M  V30 BEGIN BOND", *(f"M  V30 {k} {o} {a} {b}" for k, (o, a, b) in enumerate(bonds, 1)), "M  V30 END BOND"]
    return end.join([*lines, "M  V30 END CTAB", "M  END", "$$$$", ""])


def test_extended_records(spark, tmp_path):
    """Numbers with gaps and out of order, lines that go on, charges by name, more than 999 atoms, and what is wrong with others."""
    ring = [("C", 0.5, 1, -2, ""), ("N", 1e-1, 2, 0, "CHG=1 MASS=15"), ("O", 3, 3, 3, "RAD=1 CHG=-1")]
    chain = [("C", i, 0, 0, "") for i in range(1500)]
    texts = {
        "gaps": _extended(ring, [(2, 30, 10), (1, 10, 20)], [10, 30, 20]), "wrapped": _extended(ring, [(1, 1, 2)], wrap=True), "windows": _extended(ring, [(4, 1, 3)], end="\r\n"),
        "chain": _extended(chain, [(1, i, i + 1) for i in range(1, 1500)]), "alone": _extended(ring[:1], []), "loose": _extended(ring, [(1, 1, 7)]), "loose2": _extended(ring, [(1, 10, 7)], [10, 20, 30]),
        "short": _extended(ring, [(1, 1, 2)], counts=(4, 1)), "twice": _extended(ring, [], [1, 2, 2]), "noxyz": _extended([("C", "a", 0, 0, "")], []), "order": _extended(ring, [("x", 1, 2)]),
        "mixed": _extended(ring, [(1, 1, 2)]) + _record("p", CO, [(1, 2, 1)]),
    }
    _write(tmp_path, texts, "sdf")
    parsed = structures.parse_sdf(structures.read_sdf_records(spark, str(tmp_path)))
    reasons = {(r["name"], r["record_no"]): r["reason"] for r in parsed.collect()}
    assert {k[0]: v for k, v in reasons.items() if v} == {
        "loose": "bond to a missing atom", "loose2": "bond to a missing atom", "short": "truncated", "twice": "unreadable atom", "noxyz": "unreadable atom", "order": "unreadable bond",
    }
    assert len(reasons) == 13
    first = structures.first_record(parsed)
    atoms = {(r["name"], r["atom_idx"]): (r["symbol"], r["x"], r["y"], r["z"], r["charge"]) for r in structures.molecule_atoms(first).collect()}
    for name in ("gaps", "wrapped", "windows", "mixed"):
        assert [atoms[name, i] for i in range(3)] == [("C", 0.5, 1.0, -2.0, 0), ("N", 0.1, 2.0, 0.0, 1), ("O", 3.0, 3.0, 3.0, -1)]
    bonds = {}
    for r in structures.molecule_bonds(first).collect():
        bonds.setdefault(r["name"], set()).add((r["begin"], r["end"], r["order"]))
    assert bonds["gaps"] == {(1, 0, 2), (0, 2, 1)} and bonds["windows"] == {(0, 2, 4)} and "alone" not in bonds
    assert bonds["chain"] == {(i, i + 1, 1) for i in range(1499)} and atoms["chain", 1499][1] == 1499.0


def test_table_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,extra,b,a\nm1,q,2.5,1\nm2,q,,NaN\nm3,q,x/y,4\n")
    rows = tables.read_observations(spark, str(tmp_path), numeric=["a", "b"]).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("m1", 1.0, 2.5), ("m2", None, None), ("m3", 4.0, None)]
    bad = tables.unreadable_numbers(spark, str(tmp_path), ["a", "b"]).collect()
    assert [tuple(r) for r in bad] == [("m3", ["b"])]


def test_missing_structures_raise_only_when_strict(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, v double")
    atoms = spark.createDataFrame([("a", 0), ("a", 1)], "name string, atom_idx int")
    assert attach.attach_structure(rows, atoms, "name").count() == 2
    with pytest.raises(attach.MissingStructures):
        attach.attach_structure(rows, atoms, "name", strict=True)


def test_graph_numbers_of_a_small_molecule(spark):
    """Formamide-like: O=C-N, nitrogen charged in the second copy."""
    atoms = spark.createDataFrame(
        [(m, i, s, int(m == "ion" and s == "N")) for m in ("neutral", "ion") for i, s in enumerate("OCN")],
        "name string, atom_idx long, symbol string, charge int",
    )
    bonds = spark.createDataFrame(
        [(m, 0, 1, 2) for m in ("neutral", "ion")] + [(m, 1, 2, 1) for m in ("neutral", "ion")],
        "name string, begin long, end long, order int",
    )
    full, links = graph.add_hydrogens(atoms, bonds)
    counts = {(r["name"], r["symbol"]): r["count"] for r in full.groupBy("name", "symbol").count().collect()}
    assert counts["neutral", "H"] == 3 and counts["ion", "H"] == 4
    features = {(r["name"], r["atom_idx"]): r for r in graph.atom_features(full, links).collect()}
    assert [features["neutral", i]["valence"] for i in range(3)] == [2, 4, 3] and features["ion", 2]["valence"] == 4
    assert graph.invalid_structures(full, links).count() == 0
    broken = bonds.union(spark.createDataFrame([("ion", 0, 2, 2), ("neutral", 1, 9, 1)], bonds.schema))
    assert {tuple(r) for r in graph.invalid_structures(atoms, broken).collect()} == {
        ("ion", "too many bonds"), ("neutral", "bond to a missing atom"),
    }
    declared = spark.createDataFrame([("neutral", 3, 2), ("ion", 4, 2)], "name string, n_atoms int, n_bonds int")
    assert [tuple(r) for r in graph.invalid_structures(atoms, bonds, declared=declared).collect()] == [("ion", "count mismatch")]


def test_fingerprint_does_not_depend_on_numbering(spark):
    symbols, links = "CCONC", [(0, 1, 1), (1, 2, 2), (1, 3, 1), (3, 4, 1)]
    order = [3, 0, 4, 1, 2]
    atoms = [("p", i, s, 0) for i, s in enumerate(symbols)] + [("q", order[i], s, 0) for i, s in enumerate(symbols)]
    bonds = [("p", a, c, o) for a, c, o in links] + [("q", order[c], order[a], o) for a, c, o in links]
    out = graph.circular_fingerprint(
        spark.createDataFrame(atoms, "name string, atom_idx long, symbol string, charge int"),
        spark.createDataFrame(bonds, "name string, begin long, end long, order int"),
    ).collect()
    p, q = (next(r["on_bits"] for r in out if r["name"] == n) for n in "pq")
    assert p == q and p == sorted(set(p)) and len(p) > 3
    bits = spark.createDataFrame([(p,)], "b array<int>").select(graph.bit_array(F.col("b"))).first()[0]
    assert len(bits) == 256 and sum(bits) == len(p)


def test_score_requests_judges_every_request(spark):
    import numpy as np

    text = "2\nc\nC 1 2 3\nC 4 5 6\n"
    rows = [
        ("ok", 1.0, 2.0, text), ("zero", 0.0, 2.0, text), ("null", None, 2.0, text), ("nofile", 1.0, 2.0, None),
        ("noatom", 1.0, 2.0, "0\nc\n"), ("bad", 1.0, 2.0, "1\nc\nC 1 x 3\n"), ("long", 1.0, 2.0, text + "C 7 8 9\nC 1 1 1\n"),
    ]
    requests = spark.createDataFrame(rows, "name string, a double, b double, text string")
    model = LinearModel(np.arange(22, dtype=float).reshape(11, 2), np.array([0.5, -0.5]))
    mean, sd = [0.1 * i for i in range(11)], [1.0 + i for i in range(11)]
    scored, rejected = scoring.score_requests(requests, "name", ["a", "b"], model, (mean, sd), [(1.0, 2.0), (3.0, 4.0)], 9)
    x = (np.array([1, 2, 1, 2, 3, 4, 5, 6, 0, 0, 0.0]) - mean) / sd
    expected = (x @ model.coef + model.intercept) * [2, 4] + [1, 3]
    out = scored.collect()
    assert [r["name"] for r in out] == ["ok"] and np.allclose(out[0]["prediction"], expected)
    assert {tuple(r) for r in rejected.collect()} == {
        ("zero", "missing value"), ("null", "missing value"), ("nofile", "missing structure"), ("noatom", "missing structure"),
        ("bad", "unreadable structure"), ("long", "structure too long"),
    }


def test_quotes_line_ends_and_missing_marks(spark, tmp_path):
    rows = [(1, 'a "b" c, d', "2.5"), (2, "two\nlines", "NA"), (3, "plain", "1.5d"), (4, "", "0x1p3"), (5, None, " 7 ")]
    tables.write_csv(spark.createDataFrame(rows, "idx int, name string, value string"), str(tmp_path / "t"))
    back = tables.read_observations(spark, str(tmp_path / "t"), numeric=["value"], keep=["idx", "name"], multi_line=True)
    got = {int(r["idx"]): (r["name"], r["value"]) for r in back.collect()}
    assert got[1] == ('a "b" c, d', 2.5) and got[2] == ("two\nlines", None) and got[3][1] is None and got[4][1] is None and got[5][1] == 7.0
    bad = tables.unreadable_numbers(spark, str(tmp_path / "t"), ["value"], ["idx"], multi_line=True)
    assert sorted(int(r["idx"]) for r in bad.collect()) == [3, 4]
