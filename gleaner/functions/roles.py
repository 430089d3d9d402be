"""STR-3 role classification and JN-9 (role rules as a table).

The rules are an ordered list; the first rule whose pattern is found in the
lower-cased title names the role. Spark evaluates ``CASE WHEN`` branches in
order, so the list becomes one literal ``CASE`` expression (no join, no UDF).
``(?dU)`` makes Java's regex behave like Python's ``re`` for str patterns:
Unicode ``\\s \\w \\b`` and only ``\\n`` as line terminator for ``.``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ordered (pattern, role) rules; first match wins.
ROLE_RULES: list[tuple[str, str]] = [
    (r"product manager", "product_manager"),
    (r"(manager|mgr)[,\s]+product(?!\s+engineer)", "product_manager"),
    (r"product\s+(manager|mgr|owner|lead)", "product_manager"),
    (r"(director|vp|head)[,\s]+(?:of\s+)?product(?!\s+engineer)", "product_manager"),
    (r"technical program manager", "tpm"),
    (r"(engineering|technical)\s+program\s+manager", "tpm"),
    (r"\btpm\b", "tpm"),
    (r"program\s+(manager|mgr|mgmt|management)", "tpm"),
    (r"engineering manager", "engineering_manager"),
    (r"(manager|mgr)[,\s]+engineering", "engineering_manager"),
    (r"(manager|mgr)\s*(?:[ivx]+|\d+)?\s*[,\s]+\w[\w\s]*engineering", "engineering_manager"),
    (r"(manager|mgr).*machine learning", "engineering_manager"),
    (r"(business intelligence|data|analytics|software).*(manager|mgr)", "engineering_manager"),
    (r"(sr\.?\s*|senior\s*)(manager|mgr)", "engineering_manager"),
    (r"(director|vp|head)[,\s]+(?:of\s+)?\w", "engineering_manager"),
    (r"product\s+engineering\s+(manager|mgr)", "engineering_manager"),
    (r"(manager|mgr)[,\s]+product\s+engineering", "engineering_manager"),
    (r"engineer", "engineer"),
    (r"developer", "engineer"),
    (r"architect", "engineer"),
    (r"scientist", "engineer"),
    (r"analyst", "engineer"),
    (r"analytics", "engineer"),
]

_FLAGS = "(?dU)"


def classify_role(title: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """STR-3: first matching rule's role, NULL when none matches."""
    t = F.lower(title)
    expr = None
    for pattern, role in rules or ROLE_RULES:
        cond = t.rlike(_FLAGS + pattern)
        expr = F.when(cond, F.lit(role)) if expr is None else expr.when(cond, F.lit(role))
    return expr.otherwise(F.lit(None).cast("string"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The rule list as a (priority, pattern, role) DataFrame."""
    rows = [(i, _FLAGS + p, r) for i, (p, r) in enumerate(rules or ROLE_RULES)]
    return spark.createDataFrame(rows, "priority INT, pattern STRING, role STRING")


#: A table of rules is read as a list of at most so many.
MOST_RULES = 1000


def read_rules(rules: DataFrame, most: int = MOST_RULES) -> list:
    """The rows of a rule table by priority; a table of more than ``most`` is an error."""
    rows = rules.orderBy("priority").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a rule table may have {most} rows at most")
    return rows


def classify_role_by_table(df: DataFrame, title_col: str, key_cols: list[str],
                           rules: DataFrame) -> DataFrame:
    """JN-9 table form: ``key_cols`` and ``role`` of each row, by rules that are kept in
    a table. The table is read once, its size checked, and becomes an ordered ``CASE``:
    no join, no grouping, and a title meets no rule after the first that fits."""
    title = F.lower(F.col(title_col))
    role = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in read_rules(rules):
        role = role.when(F.rlike(title, F.lit(r.pattern)), F.lit(r.role))
    return df.select(*key_cols, role.alias("role"))
