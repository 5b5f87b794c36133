"""SQL fragments shared by the reference queries the results are compared with."""

from __future__ import annotations

X = [f"x{i}" for i in range(1, 7)]
Y = [f"y{i}" for i in range(1, 7)]


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded, with -0.0 turned into 0.0."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


OBS = """
items AS (
  SELECT l_orderkey, sum(l_quantity) x1, round(sum(l_extendedprice), 6) x2, round(avg(l_discount), 6) x3,
         round(avg(l_tax), 6) x4,
         count(*)::DOUBLE x5,
         round(sum(l_extendedprice * (1 - l_discount)), 6) y1,
         round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) y2,
         max(l_extendedprice) y3, round(sum(l_quantity * l_discount), 6) y4, min(l_extendedprice) y5
  FROM lineitem GROUP BY l_orderkey),
obs AS (
  SELECT l_orderkey AS idx, 'sys_' || l_orderkey AS name, x1 AS mass_au, x1, x2, x3, x4, x5, o_totalprice AS x6,
         y1, y2, y3, y4, y5, c_acctbal AS y6
  FROM items JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

GAPS = OBS + """,
gaps AS (
  SELECT idx, name, mass_au, x1, x2, CASE WHEN idx % 17 <> 0 THEN x3 END x3, x4, x5,
         CASE WHEN idx % 23 <> 0 THEN x6 END x6,
         y1, CASE WHEN idx % 29 <> 0 THEN y2 END y2, y3, CASE WHEN idx % 19 <> 0 THEN y4 END y4, y5, y6
  FROM obs)"""

ATOMS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 256, l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS item_no
  FROM lineitem),
atoms AS (
  SELECT l_orderkey AS idx, 'sys_' || l_orderkey || '_' || (item_no // 72) AS name, item_no % 72 AS atom_idx,
         CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS symbol,
         l_quantity AS x, l_discount AS y, l_tax AS z,
         CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END AS left_order
  FROM numbered),
bonds AS (
  SELECT a.idx, a.name, a.atom_idx AS "begin", b.atom_idx AS "end", a.left_order AS "order"
  FROM atoms a JOIN atoms b ON a.name = b.name AND b.atom_idx = a.atom_idx + 1)"""


def hash32(key: str, seed) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || ':{seed}'), 1, 8))::BIGINT)"


def bucket(key: str, seed, n: int) -> str:
    return f"({hash32(key, seed)} % {n})"


def uniform(key: str, seed) -> str:
    return f"({hash32(key, seed)} / 4294967296.0::DOUBLE)"


def holdout(key: str) -> str:
    return f"(CASE WHEN {bucket(key, 'test42', 10)} = 0 THEN 'test' ELSE 'train' END)"


def three_way(key: str) -> str:
    return (
        f"(CASE WHEN {bucket(key, 'test42', 10)} = 0 THEN 'test' "
        f"WHEN {bucket(key, 'val42', 10)} = 0 THEN 'val' ELSE 'train' END)"
    )


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


def long_rows(source: str, columns, keys: str = "idx", name: str = "feature", value: str = "value") -> str:
    lead = f"{keys}, " if keys else ""
    return union_all(f"SELECT {lead}'{c}' AS {name}, {c} AS {value} FROM {source}" for c in columns)
