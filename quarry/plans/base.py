"""The registry of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.ontology import RUGD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame and the DuckDB SQL for the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


ONTO = "onto AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r[1:])) + ")" for r in RUGD) + ") AS t(label_key, name, role, default_role, catch_all))"
_PLAIN = "CASE WHEN role = 'borderline' THEN coalesce(default_role, 'id_terrain') ELSE role END"


def resolved_sql(name: str, dataset: str = "", ood: list[str] | None = None) -> str:
    """CTEs that end in `name`, the resolved classes of onto, of each dataset by itself; with ood by the competitor's rules."""
    d, by = (f"{dataset}, ", f"{dataset}, gt") if dataset else ("", "gt")
    role = _PLAIN
    if ood is not None:
        role = "CASE WHEN name IN (" + ", ".join(map(_value, ood)) + f") THEN 'ood_tier1' WHEN role = 'ignore' OR catch_all THEN 'ignore' WHEN starts_with({_PLAIN}, 'ood') THEN 'id_terrain' ELSE {_PLAIN} END"
    return f"""{name}_role AS (SELECT {d}label_key, name, role, {role} AS eff_role, role = 'borderline' AS is_border FROM onto),
{name}_gt AS (SELECT *, CASE WHEN eff_role IN ('ood_tier1', 'ood_tier2', 'ood_tier3') THEN 'T' || eff_role[9:9] ELSE '' END AS tier,
  CASE WHEN starts_with(eff_role, 'ood_') THEN 1 WHEN starts_with(eff_role, 'id_') THEN 0 ELSE 255 END AS gt FROM {name}_role),
{name} AS (SELECT *, CASE WHEN gt = 0 THEN CAST(row_number() OVER (PARTITION BY {by} ORDER BY label_key) - 1 AS INTEGER) ELSE 255 END AS train_id FROM {name}_gt)"""


RESOLVED = ONTO + ",\n" + resolved_sql("resolved")
PIXELS = RESOLVED + """,
pixels AS (
  SELECT l_suppkey AS frame_id, s_nationkey AS site, CASE WHEN s_nationkey % 5 = 3 THEN 'val' WHEN s_nationkey % 5 = 4 THEN 'test' ELSE 'train' END AS split,
         CAST(substr(p_brand, 7) AS INT) - 1 AS label_key, p_type AS predclass, p_size AS predclass_fine, l_extendedprice AS score_a, l_quantity AS score_b,
         l_orderkey, l_linenumber, l_partkey, name, eff_role, tier, is_border, coalesce(train_id, 255) AS train_id, coalesce(gt, 255) AS gt
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN resolved ON label_key = CAST(substr(p_brand, 7) AS INT) - 1
)"""
METHODS = PIXELS + """,
methods AS (SELECT *, 'score_a' AS method, score_a AS score FROM pixels UNION ALL SELECT *, 'score_b' AS method, score_b AS score FROM pixels)"""
GRID = """grid AS (
  SELECT CAST(floor(vec_id / 20.0) AS BIGINT) AS frame_id, CAST(vec_id % 20 AS INT) AS y, unnest(generate_series(0, 63)) AS x, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings
), gridded AS (
  SELECT *, CASE WHEN y < 3 AND x < 5 THEN 255 WHEN y >= 5 AND y < 12 AND x >= 20 AND x < 40 THEN 1 ELSE 0 END AS gt FROM grid
)"""
FEATURES = """features AS (
  SELECT vec_id, label, embedding, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 10) AS logits, vec_id % 5 = 0 AS is_query, CASE WHEN label >= 8 THEN 1 ELSE 0 END AS gt FROM embeddings
)"""


def order_sql(seed: int) -> str:
    return f"(frame_id * 7919 + l_orderkey * 104729 + CAST(l_linenumber AS BIGINT) * 1299709 + l_partkey * 15485863 + 1000 + {seed}) % 2147483647"


def points_sql(src: str, by: str, name: str = "pts", score: str = "score", where: str = "gt IN (0, 1)", weight: str = "1") -> str:
    """CTEs that end in `name`: by, score, p, n, tp, fp, pos, neg."""
    b = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"""{name}_c AS (
  SELECT {b}CAST({score} AS DOUBLE) AS score, sum(CASE WHEN gt = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN gt = 0 THEN {weight} ELSE 0 END) AS n FROM {src} WHERE {where} GROUP BY {b}CAST({score} AS DOUBLE)
), {name} AS (
  SELECT *, sum(p) OVER ({over}ORDER BY score DESC) AS tp, sum(n) OVER ({over}ORDER BY score DESC) AS fp, sum(p) OVER ({over}) AS pos, sum(n) OVER ({over}) AS neg FROM {name}_c
)"""


def metrics_sql(by: str, name: str = "pts", digits: int | None = 6) -> str:
    b, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    r = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    both = "CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN {} END"
    ap = both.format(r("sum(CAST(p AS DOUBLE) / nullif(pos, 0) * CAST(tp AS DOUBLE) / (tp + fp))"))
    auroc = both.format(r("sum(CAST(n AS DOUBLE) * (tp - p / 2.0)) / max(CAST(pos AS DOUBLE) * neg)"))
    fpr95 = both.format(r("min(CASE WHEN CAST(tp AS DOUBLE) / nullif(pos, 0) >= 0.95 THEN CAST(fp AS DOUBLE) / nullif(neg, 0) END)"))
    return f"SELECT {b}{ap} AS ap, {auroc} AS auroc, {fpr95} AS fpr95, CAST(max(pos) AS BIGINT) AS n_pos FROM {name}{group}"


def op_sql(src: str, by: str = "") -> str:
    """The operating point of rows with gt and flag."""
    b, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {b}round(CAST(count(*) FILTER (gt = 0 AND flag) AS DOUBLE) / greatest(count(*) FILTER (gt = 0), 1), 6) AS fpr,
  round(CAST(count(*) FILTER (gt = 1 AND flag) AS DOUBLE) / greatest(count(*) FILTER (gt = 1), 1), 6) AS recall,
  count(*) FILTER (gt = 0) AS n_id, count(*) FILTER (gt = 1) AS n_ood FROM {src}{group}"""


def conformal_sql(src: str, by: str, name: str, score: str = "score", alpha: str = "0.05") -> str:
    """CTEs that end in `name`: by, n, tau."""
    b = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{name}_r AS (
  SELECT {b}CAST({score} AS DOUBLE) AS s, row_number() OVER ({over} ORDER BY {score}) AS r, count(*) OVER ({over}) AS n FROM {src}
), {name} AS (
  SELECT {b}max(n) AS n, coalesce(min(CASE WHEN r = CAST(ceil((n + 1) * CAST(1 - CAST({alpha} AS DOUBLE) AS DOUBLE)) AS BIGINT) THEN s END), CAST('Infinity' AS DOUBLE)) AS tau FROM {name}_r{group}
)"""


def axis_sql(source: int, target: int, name: str) -> str:
    """CTEs that end in `name` (t, s, w): the weights of the source's rows in each row of the target, bilinear."""
    return f"""{name}_p AS (SELECT CAST(t AS INTEGER) AS t, greatest((t + 0.5) * ({source}e0 / {target}e0) - 0.5, 0e0) AS p FROM (SELECT unnest(generate_series(0, {target - 1})) AS t)),
{name}_l AS (SELECT t, CAST(least(floor(p), {source - 1}) AS INTEGER) AS lo, p FROM {name}_p),
{name} AS (SELECT t, s, sum(w) AS w FROM (SELECT t, lo AS s, 1 - least(p - lo, 1e0) AS w FROM {name}_l UNION ALL SELECT t, least(lo + 1, {source - 1}), least(p - lo, 1e0) FROM {name}_l) GROUP BY t, s)"""
