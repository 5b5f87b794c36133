"""XYZ and SDF structure files as long tables.

Small files are read whole, one row per file, and numbered inside the row. A file
above ``WHOLE_FILE_BYTES`` is read in ranges of bytes that end with a line (XYZ) or a record (SDF), so a
single file that holds much of the data is still spread over many tasks. A task numbers what it reads of a range as it
comes; how many there are in the ranges before is counted apart, so no text is moved for its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strucreg.functions.columns import to_numeric
from strucreg.operators.numbering import number_in_ranges

WHOLE_FILE_BYTES = 32 * 1024 * 1024

LINE_END = r"\r\n|\r|\n"
# Charge of the codes in an atom line.
CHARGE_OF_CODE = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


def _stem(suffix: str) -> Column:
    """The file name without suffix; it comes percent-encoded, and a plus sign is itself."""
    name = F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B"))
    return F.regexp_replace(name, rf"\.{suffix}$", "")


def _whole_files(spark: SparkSession, path: str, suffix: str, limit: int) -> DataFrame:
    files = spark.read.option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True)
    return files.filter(F.col("_metadata.file_size") <= limit).select(_stem(suffix).alias("name"), F.col("value").alias("text"))


def _split_files(spark: SparkSession, path: str, suffix: str, limit: int, line_sep: str) -> DataFrame:
    """Pieces of the large files, in the order of the file within the range of bytes that begins at ``block``. Files are cut at one
    separator only, as a reader of several would also split between the two characters of one line end."""
    files = spark.read.option("pathGlobFilter", f"*.{suffix}").text(path, lineSep=line_sep)
    return files.filter(F.col("_metadata.file_size") > limit).select(
        _stem(suffix).alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("text"),
    )


# --- XYZ ------------------------------------------------------------------


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _atom_columns() -> list[Column]:
    x, y, z = (to_numeric(F.col("t")[i]) for i in (1, 2, 3))
    return [
        F.col("t")[0].alias("symbol"),
        x.alias("x"),
        y.alias("y"),
        z.alias("z"),
        (x.isNotNull() & y.isNotNull() & z.isNotNull()).alias("valid"),
    ]


def parse_xyz_text(files: DataFrame) -> DataFrame:
    """``(name, text)`` to ``(name, atom_idx, symbol, x, y, z, valid)``.

    Two header lines are skipped and only lines of four tokens count; a token that is
    no number leaves its line in place with ``valid`` false.
    """
    lines = F.split("text", LINE_END)
    lines = F.slice(lines, F.lit(3), F.size(lines))
    rows = F.filter(F.transform(lines, _tokens), lambda t: F.size(t) == 4)
    return files.select("name", F.posexplode(rows).alias("atom_idx", "t")).select(
        "name", F.col("atom_idx").cast("bigint"), *_atom_columns()
    )


def parse_xyz_lines(pieces: DataFrame) -> DataFrame:
    """The same for ``(name, block, text)`` pieces, cut at line feeds, of files too large for one row.

    A piece is a line, or several where the file ends lines by a carriage return.
    """
    text = F.regexp_replace("text", r"\r$", "")
    lines = pieces.select("name", "block", F.explode(F.split(text, r"\r")).alias("text"))
    numbered = number_in_ranges(lines, ["name"], "block", "line_no")
    atoms = numbered.filter(F.col("line_no") >= 2).withColumn("t", _tokens(F.col("text"))).filter(F.size("t") == 4)
    numbered = number_in_ranges(atoms.select("name", "block", "t"), ["name"], "block", "atom_idx")
    return numbered.select("name", "atom_idx", *_atom_columns())


def read_xyz(spark: SparkSession, path: str, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    small = parse_xyz_text(_whole_files(spark, path, "xyz", whole_file_bytes))
    large = parse_xyz_lines(_split_files(spark, path, "xyz", whole_file_bytes, "\n"))
    return small.unionByName(large)


def quarantine_structures(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms of clean structures, and ``(name, n_bad)`` of the structures set aside whole."""
    bad = atoms.groupBy("name").agg(F.count_if(~F.col("valid")).alias("n_bad")).filter(F.col("n_bad") > 0)
    return atoms.join(bad.select("name"), "name", "left_anti").drop("valid"), bad


# --- SDF ------------------------------------------------------------


def split_sdf_text(files: DataFrame) -> DataFrame:
    """``(name, text)`` to ``(name, record_no, record)``, blank records dropped."""
    records = F.posexplode(F.split("text", r"\$\$\$\$[ \t]*(?:\r\n|\r|\n)?")).alias("record_no", "record")
    return files.select("name", records).filter(F.col("record").rlike(r"\S"))


def read_sdf_records(spark: SparkSession, path: str, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    small = split_sdf_text(_whole_files(spark, path, "sdf", whole_file_bytes))
    pieces = _split_files(spark, path, "sdf", whole_file_bytes, "$$$$")
    numbered = number_in_ranges(pieces, ["name"], "block", "record_no")
    # every piece but the first starts with the line end of its separator
    record = F.when(F.col("record_no") == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[ \t]*(?:\r\n|\r|\n)", ""))
    large = numbered.select("name", "record_no", record.alias("record")).filter(F.col("record").rlike(r"\S"))
    return small.withColumn("record_no", F.col("record_no").cast("bigint")).unionByName(large)


def _int(line: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(line, start, length)).try_cast("int")


def _coordinate(line: Column, start: int) -> Column:
    return to_numeric(F.substring(line, start, 10))


_ATOMS = "array<struct<symbol:string,x:double,y:double,z:double,charge_code:int>>"


def _plain_format() -> Column:
    """Counts, atoms, bonds and charges by columns. The counts have three digits, so a record holds at most 999 atoms and 999 bonds."""
    n_atoms = F.greatest(F.coalesce("n_atoms", F.lit(0)), F.lit(0))
    n_bonds = F.greatest(F.coalesce("n_bonds", F.lit(0)), F.lit(0))
    charge_pairs = F.flatten(
        F.transform(
            F.filter("lines", lambda s: s.startswith("M  CHG")),
            lambda s: _charges(F.split(F.trim(F.regexp_replace(F.substr(s, F.lit(10)), r"\s+", " ")), " ")),
        )
    )
    return F.struct(
        "n_atoms",
        "n_bonds",
        F.transform(
            F.slice("lines", F.lit(5), n_atoms),
            lambda s: F.struct(
                F.trim(F.substring(s, 32, 3)).alias("symbol"),
                _coordinate(s, 1).alias("x"),
                _coordinate(s, 11).alias("y"),
                _coordinate(s, 21).alias("z"),
                _int(s, 37, 3).alias("charge_code"),
            ),
        ).alias("atoms"),
        F.transform(
            F.slice("lines", n_atoms + 5, n_bonds),
            lambda s: F.struct(
                (_int(s, 1, 3) - 1).alias("begin"), (_int(s, 4, 3) - 1).alias("end"), _int(s, 7, 3).alias("order")
            ),
        ).alias("bonds"),
        charge_pairs.alias("charges"),
        F.lit(False).alias("misnumbered"),
    )


def _section(lines: str, name: str) -> Column:
    """The lines between BEGIN and END of a section, as tokens; NULL without the section."""
    begin = F.array_position(lines, f"BEGIN {name}")
    end = F.array_position(lines, f"END {name}")
    inside = F.slice(lines, (begin + 1).cast("int"), (end - begin - 1).cast("int"))
    return F.when((begin > 0) & (end > begin), F.transform(inside, lambda s: F.split(s, " ")))


def _extended_format(records: DataFrame) -> tuple[DataFrame, Column]:
    """Counts, atoms, bonds and charges by tokens: numbered lines that may go on, atom numbers in any order and with gaps, charges as CHG=n.
    Bonds name atoms by their numbers; a bond to a number that no atom has leads to a missing atom. The tokens are columns of the records
    that are ``extended``, NULL in the others."""
    content = F.transform(F.filter("lines", lambda s: s.startswith("M  V30 ")), lambda s: F.trim(F.substr(s, F.lit(8))))
    # a line that ends with a hyphen goes on in the next one
    joined = F.regexp_replace(F.array_join(content, "\n"), r"-\n", " ")
    tidy = F.transform(F.split(joined, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    counts = F.split(F.get(F.filter("tidy", lambda s: s.startswith("COUNTS ")), F.lit(0)), " ")
    parts = records.withColumn("tidy", F.when(F.col("extended"), tidy)).withColumns(
        {"counted": counts, "atom_lines": _section("tidy", "ATOM"), "bond_lines": _section("tidy", "BOND")}
    )
    token = lambda t, i: F.get(t, F.lit(i))
    none = F.array().cast("array<array<string>>")
    parts = parts.withColumns({n: F.when(F.col("extended"), F.coalesce(n, none)) for n in ("atom_lines", "bond_lines")})
    parts = parts.withColumn("numbers", F.transform("atom_lines", lambda t: token(t, 0).try_cast("int")))
    charge = lambda t: F.regexp_extract(F.array_join(t, " "), r"(?:^| )CHG=(-?\d+)(?: |$)", 1).try_cast("int")
    atoms = F.transform(
        "atom_lines",
        lambda t: F.struct(
            F.coalesce(F.regexp_replace(token(t, 1), '"', ""), F.lit("")).alias("symbol"),
            to_numeric(token(t, 2)).alias("x"), to_numeric(token(t, 3)).alias("y"), to_numeric(token(t, 4)).alias("z"), F.lit(0).alias("charge_code"),
        ),
    )
    in_order = F.coalesce(F.col("numbers") == F.sequence(F.lit(1), F.greatest(F.size("numbers"), F.lit(1))), F.lit(False))
    # numbers without gaps are places already; others are looked up
    place = lambda n: F.when(n.isNotNull(), F.when(in_order, n - 1).otherwise(F.coalesce(F.array_position("numbers", n).cast("int"), F.lit(0)) - 1))
    bonds = F.transform(
        "bond_lines",
        lambda t: F.struct(place(token(t, 2).try_cast("int")).alias("begin"), place(token(t, 3).try_cast("int")).alias("end"), token(t, 1).try_cast("int").alias("order")),
    )
    told = F.filter(F.transform("atom_lines", lambda t, i: F.struct(i.cast("int").alias("atom_idx"), charge(t).alias("charge"))), lambda c: c["charge"].isNotNull())
    wrong = F.exists("numbers", lambda n: n.isNull()) | (F.size(F.array_distinct("numbers")) < F.size("numbers"))
    fields = F.struct(
        token(F.col("counted"), 1).try_cast("int").alias("n_atoms"), token(F.col("counted"), 2).try_cast("int").alias("n_bonds"),
        atoms.cast(_ATOMS).alias("atoms"), bonds.alias("bonds"), told.alias("charges"), wrong.alias("misnumbered"),
    )
    return parts, fields


def parse_sdf(records: DataFrame) -> DataFrame:
    """One row per record with its atoms, bonds and charges, and the ``reason`` it is unusable, if any. Both formats of records are read."""
    lines = records.withColumn("lines", F.split("record", LINE_END)).withColumn("counts", F.get("lines", F.lit(3)))
    sized = lines.withColumns({"n_atoms": _int(F.col("counts"), 1, 3), "n_bonds": _int(F.col("counts"), 4, 3), "extended": F.coalesce(F.col("counts").rlike(r"\bV3000\b"), F.lit(False))})
    parts, fields = _extended_format(sized)
    # both formats in one pass, as what gives the records is not read twice then; a generator keeps later filters from repeating
    # the parse once per reference
    parsed = parts.select("name", "record_no", F.inline(F.array(F.when(F.col("extended"), fields).otherwise(_plain_format()))))
    bad_atom = F.exists("atoms", lambda a: a.x.isNull() | a.y.isNull() | a.z.isNull() | (a.symbol == ""))
    bad_bond = F.exists("bonds", lambda b: b.begin.isNull() | b.end.isNull() | b.order.isNull())
    loose_bond = F.exists(
        "bonds", lambda b: (b.begin < 0) | (b.end < 0) | (b.begin >= F.col("n_atoms")) | (b.end >= F.col("n_atoms"))
    )
    reason = (
        F.when(F.col("n_atoms").isNull() | F.col("n_bonds").isNull(), "unreadable counts")
        .when((F.size("atoms") < F.col("n_atoms")) | (F.size("bonds") < F.col("n_bonds")), "truncated")
        .when(bad_atom | F.col("misnumbered"), "unreadable atom")
        .when(bad_bond, "unreadable bond")
        .when(loose_bond, "bond to a missing atom")
    )
    return parsed.withColumn("reason", reason).drop("misnumbered")


def _charges(tokens: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(tokens) - 2) / 2).cast("int"))
    return F.when(
        F.size(tokens) >= 2,
        F.transform(
            pairs,
            lambda i: F.struct(
                (F.get(tokens, i * 2).try_cast("int") - 1).alias("atom_idx"),
                F.get(tokens, i * 2 + 1).try_cast("int").alias("charge"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<atom_idx:int,charge:int>>"))


def first_record(parsed: DataFrame, keep: str = "first") -> DataFrame:
    """One usable record per structure name (the first, or the last on request)."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    usable = parsed.filter(F.col("reason").isNull())
    row = F.struct(*[c for c in usable.columns if c not in ("name", "reason")])
    return usable.groupBy("name").agg(pick(row, F.col("record_no")).alias("r")).select("name", "r.*")


def molecule_atoms(molecules: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``(keys, atom_idx, symbol, x, y, z, charge)``. Charge lines, where there are any, replace the codes of all atom lines."""
    listed = F.aggregate(
        F.filter("charges", lambda c: c.atom_idx == F.col("atom_idx")), F.lit(0), lambda total, c: c.charge
    )
    coded = F.lit(0)
    for code, value in CHARGE_OF_CODE.items():
        coded = F.when(F.col("a.charge_code") == code, value).otherwise(coded)
    charge = F.when(F.size("charges") > 0, listed).otherwise(coded)
    return molecules.select(*keys, "charges", F.posexplode("atoms").alias("atom_idx", "a")).select(
        *keys, F.col("atom_idx").cast("bigint"), "a.symbol", "a.x", "a.y", "a.z", charge.alias("charge")
    )


def molecule_bonds(molecules: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``(keys, begin, end, order)`` with atom numbers from 0."""
    return molecules.select(*keys, F.explode("bonds").alias("b")).select(
        *keys, F.col("b.begin").cast("bigint").alias("begin"), F.col("b.end").cast("bigint").alias("end"), "b.order"
    )
