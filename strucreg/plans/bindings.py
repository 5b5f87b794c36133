"""The driver tables seen as observations, structures and graphs.

One observation is an order with line items; its line items are the atoms. A system is
a run of at most ``SYSTEM_ATOMS`` consecutive atoms of an order, so an order of any size
becomes many systems rather than one unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strucreg.functions.columns import nan_to_null
from strucreg.operators.numbering import number_within

X = [f"x{i}" for i in range(1, 7)]
Y = [f"y{i}" for i in range(1, 7)]
# Fixed value: 72 atoms, 216 coordinates, is the length a scoring request may have.
SYSTEM_ATOMS = 72
# Nitrogens beyond this x are charged.
CHARGED_ABOVE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, name, mass_au, x1..x6, y1..y6``: one row per order.

    Sums are rounded, so that a value does not depend on the order of addition.
    """
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("x1"),
            F.round(F.sum(price), 6).alias("x2"),
            F.round(F.avg(discount), 6).alias("x3"),
            F.round(F.avg(tax), 6).alias("x4"),
            F.count(F.lit(1)).cast("double").alias("x5"),
            F.round(F.sum(price * (1 - discount)), 6).alias("y1"),
            F.round(F.sum(price * (1 - discount) * (1 + tax)), 6).alias("y2"),
            F.max(price).alias("y3"),
            F.round(F.sum(F.col("l_quantity") * discount), 6).alias("y4"),
            F.min(price).alias("y5"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("x6"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("y6"))
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_orderkey").alias("idx"),
            F.concat(F.lit("sys_"), F.col("l_orderkey").cast("string")).alias("name"),
            F.col("x1").alias("mass_au"),
            *X,
            *Y,
        )
    )


def observations_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with missing values: NULL in x3 and y4, NaN (made NULL on load) in x6 and y2."""
    idx = F.col("idx")
    holes = observations(spark, sf_dir).withColumns(
        {
            "x3": F.when(idx % 17 != 0, F.col("x3")),
            "y4": F.when(idx % 19 != 0, F.col("y4")),
            "x6": F.when(idx % 23 == 0, F.lit(float("nan"))).otherwise(F.col("x6")),
            "y2": F.when(idx % 29 == 0, F.lit(float("nan"))).otherwise(F.col("y2")),
        }
    )
    return nan_to_null(holes, [*X, *Y])


def numbered_items(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    items = table(spark, sf_dir, "lineitem")
    return number_within(items, ["l_orderkey"], F.col("l_partkey") % 256, order, "item_no", **options)


def system_name(idx: Column, part: Column) -> Column:
    return F.concat_ws("_", F.lit("sys"), idx.cast("string"), part.cast("string"))


def atoms(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """``idx, part, name, atom_idx, symbol, x, y, z, left_order``; (idx, part) and name are both a system's key."""
    system = F.floor(F.col("item_no") / SYSTEM_ATOMS)
    symbol = (
        F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "N").otherwise("O")
    )
    return numbered_items(spark, sf_dir, **options).select(
        F.col("l_orderkey").alias("idx"),
        system.alias("part"),
        system_name(F.col("l_orderkey"), system).alias("name"),
        (F.col("item_no") % SYSTEM_ATOMS).alias("atom_idx"),
        symbol.alias("symbol"),
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"),
        F.col("l_tax").alias("z"),
        F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("left_order"),
    )


def bonds(atom_rows: DataFrame) -> DataFrame:
    """``idx, part, begin, end, order``: a path through each system."""
    following = F.lead("atom_idx").over(W.partitionBy("idx", "part").orderBy("atom_idx"))
    return (
        atom_rows.select("idx", "part", F.col("atom_idx").alias("begin"), following.alias("end"), F.col("left_order").alias("order"))
        .filter(F.col("end").isNotNull())
    )


def xyz_text(atom_rows: DataFrame) -> DataFrame:
    """``name, text``: the XYZ file of each system (at most 72 atom lines)."""
    line = F.format_string("%s %.2f %.2f %.2f", "symbol", "x", "y", "z")
    lines = F.array_sort(F.collect_list(F.struct("atom_idx", line.alias("line"))))
    grouped = atom_rows.groupBy("idx", "part", "name").agg(lines.alias("a"))
    body = F.array_join(F.col("a.line"), "\n")
    return grouped.select("name", F.concat_ws("\n", F.size("a").cast("string"), F.col("name"), body).alias("text"))


def sdf_text(atom_rows: DataFrame) -> DataFrame:
    """``name, text``: the SDF file of each system, two records: the structure and a copy without bonds. Every fifth order has the
    extended format, with atom numbers in steps of ten and lines that go on."""
    following = F.lead("atom_idx").over(W.partitionBy("idx", "part").orderBy("atom_idx"))
    charged = (F.col("symbol") == "N") & (F.col("x") > CHARGED_ABOVE)
    # fixed value: code 3 of an atom line is a charge of one
    atom_line = F.format_string("%10.4f%10.4f%10.4f %-3s 0%3d", "x", "y", "z", "symbol", F.when(charged, 3).otherwise(0))
    bond_line = F.when(
        F.col("following").isNotNull(),
        F.format_string("%3d%3d%3d  0", F.col("atom_idx") + 1, F.col("following") + 1, F.col("left_order")),
    )
    number = F.col("atom_idx") * 10 + 10
    long_atom = F.format_string("M  V30 %d %s %.4f -\nM  V30 %.4f %.4f 0%s", number, "symbol", "x", "y", "z", F.when(charged, " CHG=1").otherwise(""))
    long_bond = F.when(
        F.col("following").isNotNull(),
        F.format_string("M  V30 %d %d %d %d", F.col("atom_idx") + 1, "left_order", number, F.col("following") * 10 + 10),
    )
    extended = F.col("idx") % 5 == 0
    grouped = (
        atom_rows.withColumn("following", following)
        .groupBy("idx", "part", "name")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("atom_idx", F.when(extended, long_atom).otherwise(atom_line).alias("a"), F.when(extended, long_bond).otherwise(bond_line).alias("b"))
                )
            ).alias("rows")
        )
    )
    n_atoms, bond_lines = F.size("rows"), F.array_compact(F.col("rows.b"))

    def record(bond_part, n_bonds):
        head = F.array(F.col("name"), F.lit("  rendered"), F.lit(""))
        plain = F.concat(head, F.array(F.format_string("%3d%3d  0  0  0", n_atoms, n_bonds)), F.col("rows.a"), bond_part)
        section = lambda name, lines: F.concat(F.array(F.lit(f"M  V30 BEGIN {name}")), lines, F.array(F.lit(f"M  V30 END {name}")))
        counts = F.array(F.format_string("M  V30 COUNTS %d %d 0 0 0", n_atoms, n_bonds))
        table = section("CTAB", F.concat(counts, section("ATOM", F.col("rows.a")), section("BOND", bond_part)))
        longer = F.concat(head, F.array(F.lit("  0  0  0  0  0            999 V3000")), table)
        return F.array_join(F.concat(F.when(extended, longer).otherwise(plain), F.array(F.lit("M  END"), F.lit("$$$$\n"))), "\n")

    bare = record(F.array().cast("array<string>"), F.lit(0))
    return grouped.select("name", F.concat(record(bond_lines, F.size(bond_lines)), bare).alias("text"))
