"""Text screening and intent routing over text tables.

Every check is a per-row column expression; the alias and permission
tables are small fixed parameters evaluated inside the expression, so no
join (and no nested-loop join) is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: PII patterns (checked in this order), sensitive phrases,
# roles allowed to use tools
PII_PATTERNS = (
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b(?:\d[ -]*?){13,16}\b"),
)
SENSITIVE_TERMS = ("export customer emails", "show raw pii", "ignore rbac", "bypass policy", "leak prompt")
TOOL_ROLES = ("marketing_analyst", "admin")


def screen_prompts(df: DataFrame, text: str = "question", role: str = "role") -> DataFrame:
    """Allowed flag, reason and the checks passed for every row."""
    t, r = F.coalesce(F.col(text), F.lit("")), F.col(role)
    low = F.lower(t)
    base = ["role_present", "prompt_length"]
    sensitive = F.lit(False)
    for term in SENSITIVE_TERMS:
        sensitive = sensitive | low.contains(term)
    rbac_ok = r.isin(*TOOL_ROLES)

    def checks(names):
        return F.array(*[F.lit(n) for n in names])
    # Cheap guards in front of the regexes (same result): an email needs an
    # '@', the numeric patterns need a digit.  Most texts skip the regexes.
    has_at = F.instr(t, "@") > 0
    has_digit = t.rlike("[0-9]")
    guard = {"email": has_at}
    reason = None
    chk = None
    for name, pattern in PII_PATTERNS:
        hit = guard.get(name, F.col("_has_digit")) & t.rlike(pattern)
        reason = (F.when(hit, F.lit(f"Blocked possible {name} in prompt")) if reason is None
                  else reason.when(hit, F.lit(f"Blocked possible {name} in prompt")))
        chk = F.when(hit, checks(base + ["pii_block"])) if chk is None else chk.when(hit, checks(base + ["pii_block"]))
    reason = (reason.when(sensitive, F.lit("Blocked sensitive data or policy bypass request"))
                    .when(~rbac_ok, F.lit("Role is not authorized for copilot tools"))
                    .otherwise(F.lit("Allowed")))
    chk = (chk.when(sensitive, checks(base + ["pii_block", "sensitive_intent"]))
              .when(~rbac_ok, checks(base + ["pii_block", "sensitive_intent", "tool_rbac"]))
              .otherwise(checks(base + ["pii_block", "sensitive_intent", "tool_rbac"])))
    staged = df.withColumn("_has_digit", has_digit)
    return staged.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "Allowed") \
                 .withColumn("checks", chk).drop("_has_digit")


def route_intents(df: DataFrame, aliases: list[tuple[str, tuple[str, ...]]], text: str = "question") -> DataFrame:
    """Every intent with an alias contained in the lower-cased text, in
    alias-table order."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = []
    for intent, names in aliases:
        cond = F.lit(False)
        for a in names:
            cond = cond | low.contains(a)
        hits.append(F.when(cond, F.lit(intent)))
    return df.withColumn("requested", F.array_compact(F.array(*hits)))


def authorize(df: DataFrame, allowed_by_role: dict[str, list[str]], role: str = "role",
              requested: str = "requested", fallback: int = 3) -> DataFrame:
    """Requested intents the role may use, else the role's first
    ``fallback`` allowed intents."""
    allowed = F.coalesce(F.element_at(F.create_map(*[x for k, v in allowed_by_role.items()
                                                     for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]),
                                      F.col(role)), F.array().cast("array<string>"))
    kept = F.filter(F.col(requested), lambda i: F.array_contains(allowed, i))
    return df.withColumn("authorized", F.when(F.size(kept) > 0, kept).otherwise(F.slice(allowed, 1, fallback)))
