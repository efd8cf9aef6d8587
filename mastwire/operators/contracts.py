"""Rule checking: every failure of every rule, summarised per column and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The data break their contract; the message lists every problem."""


Rules = list[tuple[str, str, Column, Column]]
RULES_PER_PASS = 30


def failure_counts(df: DataFrame, rules: Rules) -> list[tuple[int, int]]:
    """(rule position, failing rows) for every rule that fails, from one aggregation."""
    broken = [F.count_if(~F.coalesce(passes, F.lit(False))).alias(f"r{i}") for i, (_, _, passes, _) in enumerate(rules)]
    row = df.agg(*broken).first()
    return [(i, row[f"r{i}"]) for i in range(len(rules)) if row[f"r{i}"]]


def failures(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per failed rule and row: column, check and the offending value as text."""
    failed = [
        F.when(
            ~F.coalesce(passes, F.lit(False)),
            F.struct(
                F.lit(column).alias("column"), F.lit(check).alias("check"), example.cast("string").alias("example")
            ),
        )
        for column, check, passes, example in rules
    ]
    return df.select(F.explode(F.array(*failed)).alias("f")).where(F.col("f").isNotNull()).select("f.*")


def summarize(df: DataFrame, rules: Rules, examples: int = 3) -> DataFrame:
    """Failures per column and check, with up to three distinct examples.

    One aggregation counts the failures of every rule; only rules that fail are looked at
    again for examples. Equal examples are merged first, so a rule that fails everywhere
    stays spread out, and the ranking keeps the first few before anything is gathered.
    """
    counts = failure_counts(df, rules)
    failing = [rules[i] for i, _ in counts]
    rows = [(rules[i][0], rules[i][1], n) for i, n in counts]
    totals = df.sparkSession.createDataFrame(rows, "column string, check string, failures bigint")
    found = None
    for start in range(0, len(failing), RULES_PER_PASS):
        part = failures(df, failing[start : start + RULES_PER_PASS])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return totals.withColumn("examples", F.lit(None).cast("string"))
    first = Window.partitionBy("column", "check").orderBy("example")
    shown = found.where(F.col("example").isNotNull()).distinct().withColumn("_i", F.row_number().over(first))
    shown = shown.where(F.col("_i") <= examples).groupBy("column", "check").agg(
        F.array_join(F.array_sort(F.collect_list("example")), ", ").alias("examples")
    )
    return totals.join(shown, ["column", "check"], "left")


def require(df: DataFrame, rules, subject: str, table_failures: list[str] | None = None) -> DataFrame:
    """The data unchanged, or an error naming every failed rule with counts and examples."""
    lines = [
        f"- {r['column']}: {r['check']} failed {r['failures']} times (examples: {r['examples'] or ''})"
        for r in summarize(df, rules).orderBy("column", "check").collect()
    ]
    lines += [f"- {t}" for t in table_failures or []]
    if lines:
        raise ContractError(f"{subject} ({len(lines)} problems):\n" + "\n".join(lines))
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A many-to-one join that refuses a right side with repeated keys."""
    if repeated_keys(right, keys).take(1):
        raise ContractError(f"The right side repeats a key of {keys}.")
    return left.join(right, keys, how)


def replace_columns(base: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Replace a block of feature columns by key, dropping stale copies left by older joins."""
    stale = [c for c in base.columns if c in features.columns and c != key]
    stale += [c for c in base.columns if c.endswith(("_x", "_y")) and c[:-2] in features.columns]
    return join_checked(base.drop(*stale), features, [key])


def validity_rules(columns: dict[str, Column], subject: Column) -> list[tuple[str, str, Column, Column]]:
    return [(name, "valid", passes, subject) for name, passes in columns.items()]


def ledger(df: DataFrame, reasons: dict[str, Column], name: str = "rejection_reason") -> DataFrame:
    """Add every applicable reason code, in order, joined by semicolons; empty when valid."""
    codes = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in reasons.items()]
    return df.withColumn(name, F.concat_ws(";", *codes))


def reconciled(total: int, *parts: int) -> bool:
    """Input rows equal what was kept, rejected and dropped as duplicates."""
    return total == sum(parts)
