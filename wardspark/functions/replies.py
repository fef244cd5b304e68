"""Reading model replies: JSON inside prose, small repairs, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.fixed import AUDIT_FIX_HEAD, CHAIN_DEFAULT_NAME, CHAIN_DEFAULT_RISK, OLD_FIX_HEAD

AUDIT_SCHEMA = "struct<attack_path:string,exploit_demo:string,impact:string,cvss_vector:string,fix:string>"
STAGE_TEXTS = (
    "stage_name", "entry_point", "technique", "what_attacker_gains", "enables_next_stage", "prerequisites",
    "detection_difficulty",
)
STAGES = "array<struct<stage:int," + ",".join(f"{n}:string" for n in STAGE_TEXTS) + ">>"
MITIGATIONS = "array<struct<order:int,action:string,finding_ids:array<string>,effort:string>>"
CHAIN_SCHEMA = (
    f"struct<campaign_name:string,executive_summary:string,risk_level:string,attack_chain:{STAGES},"
    f"total_impact:map<string,string>,mitigation_priority:{MITIGATIONS}>"
)


#: Replies are read as JSON says: no single quotes.
STRICT = {"allowSingleQuotes": "false"}


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time, however often ``use`` looks at it."""
    return F.transform(F.array(value), use)[0]


def outer_json(reply: Column, must_hold: str | None = None) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    if must_hold is None:
        return F.regexp_extract(reply, r"\{[\s\S]*\}", 0)
    return F.regexp_extract(reply, r"\{[\s\S]*" + must_hold + r"[\s\S]*\}", 0)


def strip_comments_and_commas(text: Column, also_before_bracket: bool) -> Column:
    out = F.regexp_replace(text, F.lit(r"(?dU)//.*?\n"), F.lit("\n"))
    out = F.regexp_replace(out, F.lit(r"(?dU),\s*\}"), F.lit("}"))
    if also_before_bracket:
        out = F.regexp_replace(out, F.lit(r"(?dU),\s*\]"), F.lit("]"))
    return out


def strict_json(text: Column) -> Column:
    """The text in compact form if it is exactly one JSON value, else null.

    ``from_json`` on the bare text would ignore anything after the first value;
    inside brackets such a rest is an error.
    """
    values = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    return once(values, lambda v: F.when(F.size(v) == 1, v[0]))


def repaired_json(reply: Column, must_hold: str | None = None, also_before_bracket: bool = True) -> Column:
    """The reply's JSON as text: as it is, else after repairs, else null."""
    return once(
        outer_json(reply, must_hold),
        lambda found: F.coalesce(strict_json(found), strict_json(strip_comments_and_commas(found, also_before_bracket))),
    )


def verdict_batch(reply: Column) -> Column:
    """A classification reply as ``struct<failed, items>``.

    A reply that cannot be read gives no items.  One that can be read but holds
    a malformed item (not an object, verdict not a text) counts as failed, as
    does a ``results`` value that is not a list.  Missing verdict is REAL,
    verdicts are upper case, missing index is the position, missing reason is
    empty.
    """
    return once(repaired_json(reply, must_hold='"results"', also_before_bracket=False), _read_verdicts)


def _read_verdicts(text: Column) -> Column:
    fields = F.from_json(text, "map<string,string>", STRICT)
    raw = F.from_json(text, "struct<results:array<string>>", STRICT)["results"]
    items = F.transform(
        F.coalesce(raw, F.array().cast("array<string>")),
        lambda x, i: F.struct(
            i.alias("pos"),
            x.startswith("{").alias("is_object"),
            F.from_json(x, "map<string,variant>", STRICT).alias("item"),
        ),
    )
    # an empty object or text has no items, anything else that is not a list cannot be read as verdicts
    not_a_list = (
        raw.isNull()
        & F.coalesce(F.array_contains(F.map_keys(fields), "results"), F.lit(False))
        & ~F.coalesce(fields["results"].isin("{}", ""), F.lit(False))
    )
    return once(items, lambda found: F.struct(
        (F.exists(found, _malformed) | not_a_list).alias("failed"), F.transform(found, _verdict).alias("items")))


def _malformed(x: Column) -> Column:
    """Not an object, or a verdict that is not a text."""
    verdict_type = F.coalesce(F.schema_of_variant(x["item"]["verdict"]), F.lit("VOID"))
    return ~F.coalesce(x["is_object"], F.lit(False)) | (
        F.array_contains(F.map_keys(x["item"]), "verdict") & (verdict_type != "STRING"))


def _verdict(x: Column) -> Column:
    item = x["item"]
    return F.struct(
        x["pos"].alias("pos"),
        F.coalesce(F.try_variant_get(item["index"], "$", "bigint"), x["pos"].cast("bigint")).alias("index"),
        F.upper(F.coalesce(F.try_variant_get(item["verdict"], "$", "string"), F.lit("REAL"))).alias("verdict"),
        F.coalesce(F.try_variant_get(item["reason"], "$", "string"), F.lit("")).alias("reason"),
    )


def audit_fields(reply: Column) -> Column:
    """The five audit fields of a reply, empty where missing."""
    names = ("attack_path", "exploit_demo", "impact", "cvss_vector", "fix")
    return once(
        F.from_json(repaired_json(reply), AUDIT_SCHEMA, STRICT),
        lambda got: F.struct(*[F.coalesce(got[n], F.lit("")).alias(n) for n in names]),
    )


def audit_demo(audit: Column, old: Column) -> Column:
    """Four titled sections, only when there is an attack path."""
    text = F.concat(
        F.lit("## Attack Path\n"), audit["attack_path"], F.lit("\n\n## Exploit Demo\n"), audit["exploit_demo"],
        F.lit("\n\n## Impact\n"), audit["impact"], F.lit("\n\n## CVSS\n"), audit["cvss_vector"],
    )
    return F.when(F.length(audit["attack_path"]) > 0, text).otherwise(old)


def audit_fix(audit: Column, old: Column) -> Column:
    """The audit's fix on top of the rule's own suggestion."""
    below = F.when(F.length(old) > 0, F.concat(F.lit(OLD_FIX_HEAD), old)).otherwise(F.lit(""))
    return F.when(F.length(audit["fix"]) > 0, F.concat(F.lit(AUDIT_FIX_HEAD), audit["fix"], below)).otherwise(old)


def chain_fields(reply: Column) -> Column:
    """A chain reply with every default filled in; null when nothing could be read."""
    return once(
        repaired_json(reply),
        lambda text: F.when(text != "{}", once(F.from_json(text, CHAIN_SCHEMA, STRICT), _filled_chain)),
    )


def _filled_chain(got: Column) -> Column:
    blank = F.lit("")
    stages = F.transform(
        F.coalesce(got["attack_chain"], F.array().cast(STAGES)),
        lambda s, i: F.struct(
            F.coalesce(s["stage"], i + 1).alias("stage"),
            *[F.coalesce(s[n], blank).alias(n) for n in STAGE_TEXTS],
        ),
    )
    return F.struct(
        F.coalesce(got["campaign_name"], F.lit(CHAIN_DEFAULT_NAME)).alias("campaign_name"),
        F.coalesce(got["executive_summary"], blank).alias("executive_summary"),
        F.coalesce(got["risk_level"], F.lit(CHAIN_DEFAULT_RISK)).alias("risk_level"),
        stages.alias("stages"),
        F.coalesce(got["total_impact"], F.create_map().cast("map<string,string>")).alias("total_impact"),
        F.coalesce(got["mitigation_priority"], F.array().cast(MITIGATIONS)).alias("mitigation_priority"),
    )
