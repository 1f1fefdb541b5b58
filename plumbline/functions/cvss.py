"""CVSS v3 base score from a vector string (FIRST.org formula)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip

# CVSS v3.1 metric weights.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
PRIVILEGES_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}


def metric(vector: Column, name: str) -> Column:
    """Value of one metric of an upper-case vector; the last occurrence counts.

    An absent metric is the empty text.
    """
    mark, text = F.lit(f"/{name}:"), F.concat(F.lit("/"), vector)
    value = F.substring_index(F.substring_index(text, f"/{name}:", -1), "/", 1)
    return F.when(text.contains(mark), value).when(text.isNotNull(), F.lit(""))


def _weight(value: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for key, number in table.items():
        out = F.when(value == key, F.lit(number)).otherwise(out)
    return out


def round_up(x: Column) -> Column:
    """Ceiling to one decimal with the tolerance CVSS 3.1 prescribes."""
    return let(
        F.rint(x * 100000),
        lambda r: F.when(r % 10000 == 0, r / 100000.0).otherwise(
            (F.floor(r / 10000.0).cast("double") + 1) / 10.0
        ),
    )


def base_score(vector: Column) -> Column:
    """Base score, NULL when a base metric is missing or unknown."""
    names = ("S", "AV", "AC", "PR", "UI", "C", "I", "A")
    metrics = let(F.upper(strip(vector)), lambda v: F.struct(*[metric(v, n).alias(n) for n in names]))

    def weights(m: Column) -> Column:
        changed = F.when(m["S"] != "", m["S"] == "C")
        privileges = F.when(changed, _weight(m["PR"], PRIVILEGES_CHANGED)).otherwise(
            _weight(m["PR"], PRIVILEGES_UNCHANGED)
        )
        return F.struct(
            changed.alias("changed"),
            _weight(m["AV"], ATTACK_VECTOR).alias("av"),
            _weight(m["AC"], ATTACK_COMPLEXITY).alias("ac"),
            privileges.alias("pr"),
            _weight(m["UI"], USER_INTERACTION).alias("ui"),
            _weight(m["C"], IMPACT).alias("c"),
            _weight(m["I"], IMPACT).alias("i"),
            _weight(m["A"], IMPACT).alias("a"),
        )

    def score(m: Column) -> Column:
        iss = 1 - (1 - m["c"]) * (1 - m["i"]) * (1 - m["a"])
        impact = F.when(
            m["changed"], 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))
        ).otherwise(6.42 * iss)
        ease = F.lit(8.22) * m["av"] * m["ac"] * m["pr"] * m["ui"]
        total = impact + ease
        capped = F.least(F.when(m["changed"], 1.08 * total).otherwise(total), F.lit(10.0))
        return (
            F.when(m["changed"].isNull() | ease.isNull() | impact.isNull(), F.lit(None))
            .when(impact <= 0, F.lit(0.0))
            .otherwise(round_up(capped))
        )

    return let(let(metrics, weights), score)


def best_severity(severity: Column, prefer_scored: bool = False) -> Column:
    """The entry with the highest (version text, score).

    An unscored v4.0 entry therefore outranks a scored v3.1 one; with
    ``prefer_scored`` entries without a score are considered last.
    """
    rank = (lambda s: (s["base_score"] > 0).cast("int")) if prefer_scored else (lambda s: F.lit(0))
    ordered = F.transform(
        severity,
        lambda s: F.struct(
            rank(s).alias("r"),
            s["version"].alias("version"),
            s["base_score"].alias("base_score"),
            s["vector"].alias("vector"),
        ),
    )
    return F.array_max(ordered)
