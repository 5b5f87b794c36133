"""SDF records of both formats in one pass."""

from strucreg.sources import structures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_both_formats_are_read_once(spark):
    plain = "a\n  x\n\n  2  1  0  0  0\n    1.0000    2.0000    3.0000 C   0  0\n    4.0000    5.0000    6.0000 N   0  3\n  1  2  2  0\nM  END\n"
    longer = "b\n  x\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS 2 1 0 0 0\nM  V30 BEGIN ATOM\nM  V30 10 C 1 2 3 0\nM  V30 20 N 4 -\nM  V30 5 6 0 CHG=1\nM  V30 END ATOM\nM  V30 BEGIN BOND\nM  V30 1 2 10 20\nM  V30 END BOND\nM  V30 END CTAB\nM  END\n"
    files = spark.createDataFrame([("f", f"{plain}$$$$\n{longer}$$$$\n \t\n$$$$\n\n"), ("g", " "), ("h", None)], "name string, text string")
    parsed = structures.parse_sdf(structures.split_sdf_text(files))
    rows = {(r["name"], r["record_no"]): r for r in parsed.collect()}
    assert set(rows) == {("f", 0), ("f", 1)} and all(r["reason"] is None for r in rows.values())
    first, second = rows["f", 0], rows["f", 1]
    places = lambda r: [(a["symbol"], a["x"], a["y"], a["z"]) for a in r["atoms"]]
    assert places(first) == places(second) == [("C", 1.0, 2.0, 3.0), ("N", 4.0, 5.0, 6.0)] and first["bonds"] == second["bonds"]
    assert first["charges"] == [] and [tuple(c) for c in second["charges"]] == [(1, 1)]
    assert _plan(parsed).count("Generate explode") + _plan(parsed).count("Generate posexplode") == 1 and "Union" not in _plan(parsed)


def test_attached_molecules_leave_their_atoms_behind(spark, sf_dir):
    """Only the compared columns of a record go on to where records are compared."""
    from strucreg import catalog

    found = catalog.queries()["attach_molecule"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    compared = [line for line in plan.splitlines() if "min_by(" in line]
    assert compared and not any(c in line for line in compared for c in ("atoms, atoms", "bonds, bonds", "charges"))
    assert found.columns == ["name", "idx", "record_no", "n_atoms", "n_bonds"] and found.count() > 0
