"""Named queries over the model's tables: one SQL text where both engines read it alike, else one for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shards, table
from .views import DUCK, SPARK, TABLES

ENTRIES: dict[str, tuple[str, str]] = {}
#: Functions that the engines spell differently; @NAME(...) in a text.
MACROS = {
    "DOT": ("aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)", "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"),
    "NORM": ("sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))", "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"),
    "UNIT": ("transform({0}, x -> x / {1})", "list_transform({0}, lambda x: x / {1})"),
    "COUNT_RE": ("regexp_count({0}, {1})", "len(regexp_extract_all({0}, {1}))"),
    "REPLACE": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "RLIKE": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "DBL": ("CAST({0} AS double)", "CAST({0} AS double)"),
    "BIG": ("CAST({0} AS bigint)", "CAST({0} AS bigint)"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "STR": ("CAST({0} AS string)", "CAST({0} AS varchar)"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "JOINED": ("array_join(transform(array_sort(collect_list(struct({1}, {0}))), x -> x.{0}), {2})", "string_agg({0}, {2} ORDER BY {1})"),
    "DIV": ("({0} div {1})", "({0} // {1})"),
    "SIZE": ("size({0})", "len({0})"),
    "VECTOR": ("transform(array_sort(collect_list(struct({0}, {1}))), e -> e.{1})", "list({1} ORDER BY {0})"),
    "SORTED_SET": ("array_sort(collect_set({0}))", "list_sort(list(DISTINCT {0}))"),
    "TEXT_OF": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "PAD2": ("CASE WHEN length({0}) < 2 THEN lpad({0}, 2, '0') ELSE {0} END", "CASE WHEN length({0}) < 2 THEN lpad({0}, 2, '0') ELSE {0} END"),
    "MEDIAN": ("percentile({0}, 0.5)", "quantile_cont({0}, 0.5)"),
    "NTH": ("element_at({0}, {1})", "({0})[{1}]"),
}


def _args(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening parenthesis is at text[at - 1], and where it ends."""
    out, depth, begin, quoted = [], 0, at, False
    for i in range(at, len(text)):
        c = text[i]
        quoted ^= c == "'"
        if quoted:
            continue
        if c in "([":
            depth += 1
        elif c == ")" and depth == 0:
            return [*out, text[begin:i].strip()], i + 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unclosed call in {text[at:]}")


def expand(text: str, engine: int) -> str:
    while m := re.search(r"@(\w+)\(", text):
        args, end = _args(text, m.end())
        text = text[: m.start()] + MACROS[m[1]][engine].format(*args) + text[end:]
    return text


def query(name: str, sql: str, duck: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"{name} is defined twice")
    ENTRIES[name] = sql, duck or sql


def _resolver(spark: SparkSession, sf_dir: str):
    """Text with $names replaced by temporary views of driver tables and of the model's tables, made on first use."""
    made: set[str] = set()

    def resolve(text: str) -> str:
        for v in sorted(set(re.findall(r"\$(\w+)", text))):
            if v not in made:
                made.add(v)
                df = table(spark, sf_dir, v) if v in TABLES else spark.sql(resolve(expand(SPARK[v], 0).replace("#SHARDS", str(shards(spark)))))
                df.createOrReplaceTempView(f"turnloom_{v}")
        return re.sub(r"\$(\w+)", r"turnloom_\1", text)

    return resolve


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the model's tables."""
    return spark.sql(_resolver(spark, sf_dir)(f"SELECT * FROM ${name}"))


#: Entries that say something of each row of $revised by its text and times alone: said once for all ticks that show the same.
ONCE = {"open_ending", "sentence_terminal", "publication_terminal", "evidence_poor"}


def run(name: str):
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = expand(ENTRIES[name][0], 0)
        if name in ONCE:
            return spark.sql(_resolver(spark, sf_dir)(text.replace("$revised", "$revised_once"))).withColumn("tick_ms", F.explode("tick_ms"))
        return spark.sql(_resolver(spark, sf_dir)(text))

    plan.__name__ = name
    return plan


def oracle(name: str) -> str:
    return statement(ENTRIES[name][1])


def statement(text: str) -> str:
    """The statement for the SQL oracle, with the views it needs as common table expressions."""
    body, ctes, seen = expand(text, 1), [], set()

    def need(text: str) -> None:
        for v in re.findall(r"\$(\w+)", text):
            if v not in TABLES and v not in seen:
                seen.add(v)
                need(DUCK[v])
                ctes.append(f"v_{v} AS ({sub(expand(DUCK[v], 1))})")

    def sub(text: str) -> str:
        return re.sub(r"\$(\w+)", lambda m: m[1] if m[1] in TABLES else f"v_{m[1]}", text)

    need(body)
    body = sub(body)
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)} SELECT * FROM ({body}) q"


def queries() -> dict:
    from ..operators import kernels, pairs
    from . import definitions, rules  # noqa: F401  these register the entries

    return {n: run(n) for n in ENTRIES} | kernels.QUERIES | pairs.QUERIES


def oracles() -> dict[str, str]:
    from ..operators import kernels
    from . import definitions, rules  # noqa: F401

    return {n: oracle(n) for n in ENTRIES} | {n: statement(sql) for n, sql in kernels.ORACLE.items()}
