"""Named queries and the SQL that gives the same rows.

``query`` registers a DataFrame plan together with its DuckDB twin. ``sql_query`` registers a statement that both engines read: streams stand in braces, and a few
names stand for what the engines spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STREAMS = {
    "door": adapters.door,
    "transit": adapters.transit,
    "episode": adapters.episode,
    "gaps": lambda spark, _: adapters.gaps(spark),
    "epochs": lambda spark, _: adapters.version_epochs(spark),
    "channels": lambda spark, _: adapters.channels(spark),
}
TABLES = {"customer", "nation", "region", "orders", "lineitem", "part", "supplier", "events", "embeddings"}

#: Spelled differently: LASTNN and FIRSTNN (window, nulls ignored), PCT (linear percentile), MAXBY (the value at the maximum, null or not),
#: BUCKET (floor of a quotient), FLEET (an array of the seven channels).
SPELLED = {
    "MAXBY": ("max_by({0}, {1})", "arg_max_null({0}, {1})"),
    "LASTNN": ("last_value({0}, true)", "last_value({0} IGNORE NULLS)"),
    "FIRSTNN": ("first_value({0}, true)", "first_value({0} IGNORE NULLS)"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "DOUBLED": ("CAST({0} AS DOUBLE)", "CAST({0} AS DOUBLE)"),
    "BUCKET": ("CAST(floor(({0}) / {1}) AS BIGINT)", "CAST(floor(({0}) / {1}) AS BIGINT)"),
    "FLEET": ("array({0}, {1}, {2}, {3}, {4}, {5}, {6})", "list_value({0}, {1}, {2}, {3}, {4}, {5}, {6})"),
    "SPLITCHARS": ("split({0}, '')", "string_split({0}, '')"),
    "UNNEST": ("explode({0})", "unnest({0})"),
    "SHA256": ("sha2({0}, 256)", "sha256({0})"),
    "MATCHES": ("{0} RLIKE {1}", "regexp_matches({0}, {1})"),
}


def spelled(sql: str, engine: int) -> str:
    for name, forms in SPELLED.items():
        while m := re.search(rf"\b{name}\(", sql):
            depth, at, args, start = 1, m.end(), [], m.end()
            while depth:
                c = sql[at]
                depth += (c == "(") - (c == ")")
                if (c == "," and depth == 1) or not depth:
                    args.append(sql[start:at].strip())
                    start = at + 1
                at += 1
            sql = sql[: m.start()] + forms[engine].format(*args) + sql[at:]
    return sql


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def sql_query(name: str, sql: str) -> None:
    used = list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))
    own = spelled(sql, 0)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(own, **{n: STREAMS[n](spark, sf_dir) if n in STREAMS else adapters.table(spark, sf_dir, n) for n in used})

    QUERIES[name] = run
    duck = re.sub(r"\{(\w+)\}", r"\1", spelled(sql, 1))
    streams = [n for n in used if n in STREAMS]
    if streams:
        head = adapters.ctes(*streams)
        m = re.match(r"\s*WITH\s", duck)
        duck = head + (",\n" + duck[m.end() :] if m else "\n" + duck)
    ORACLE_SQL[name] = duck


from .plans import alphabet, degradation, demand, health, marts, more_marts, rules, sequences, signals, streams, summaries  # noqa: E402,F401  they register their queries
