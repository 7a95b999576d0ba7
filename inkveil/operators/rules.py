"""Redaction rules: from a configuration document to rows, inheritance, checks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_section

RULE_FIELDS = ("label", "model", "system_prompt", "redaction_terms", "constraints")
CONFIG = "redactors array<struct<redactor_type:string,redaction_rules:array<struct<name:string,label:string,model:string,system_prompt:string,text_redaction_rule:string,redaction_terms:array<string>,constraints:array<string>>>>>"
#: Kinds of rules that a processor of a file kind can run.
APPLICABLE = {"pdf": ("LLMTextRedaction", "ImageRedaction", "ImageTextRedaction", "ImageLLMTextRedaction"), "text": ("LLMTextRedaction",)}
#: What a prompt says about the form of the answer.
OUTPUT_FORMAT = "Return the terms exactly as they appear in the text."


def flattened(configs: DataFrame, body: str = "body") -> DataFrame:
    """Rules of configuration documents in JSON: a row each, with its redactor's type and its place."""
    rows = configs.select("config", F.posexplode(F.from_json(body, CONFIG)["redactors"]).alias("redactor_no", "r"))
    return rows.select("config", "redactor_no", F.col("r.redactor_type").alias("redactor_type"), F.posexplode("r.redaction_rules").alias("rule_no", "rule")).select("config", "redactor_no", "rule_no", "redactor_type", "rule.*")


def inherited(rules: DataFrame) -> DataFrame:
    """Image rules that name a text rule take over its fields where they have none themselves."""
    base = rules.filter("redactor_type = 'LLMTextRedaction'").select("config", F.col("name").alias("text_redaction_rule"), *[F.col(c).alias(f"base_{c}") for c in RULE_FIELDS])
    joined = rules.join(base, ["config", "text_redaction_rule"], "left")
    return joined.select("config", "redactor_no", "rule_no", "redactor_type", "name", "text_redaction_rule", *[F.coalesce(c, f"base_{c}").alias(c) for c in RULE_FIELDS])


def unknown_references(rules: DataFrame) -> DataFrame:
    """Rules that name a text rule which their configuration hasn't."""
    known = rules.filter("redactor_type = 'LLMTextRedaction'").select("config", F.col("name").alias("text_redaction_rule"))
    return rules.filter("text_redaction_rule IS NOT NULL").join(known, ["config", "text_redaction_rule"], "left_anti").select("config", "name", "text_redaction_rule")


def unknown_types(rules: DataFrame, registered: tuple[str, ...]) -> DataFrame:
    return rules.filter(~F.col("redactor_type").isin(*registered)).select("config", "name", "redactor_type")


def duplicates(rules: DataFrame) -> DataFrame:
    """Names that a configuration gives to several rules."""
    return rules.groupBy("config", "name").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_types(registered: DataFrame) -> DataFrame:
    """(type_name, providers) of types that several providers register (type_name, provider): each is an error."""
    return registered.groupBy("type_name").agg(F.array_sort(F.collect_set("provider")).alias("providers")).filter("size(providers) > 1")


def applicable(rules: DataFrame, file_kind: str) -> DataFrame:
    return rules.filter(F.col("redactor_type").isin(*APPLICABLE[file_kind]))


def system_prompt(role: Column, terms: Column, constraints: Column, output_format: str = OUTPUT_FORMAT) -> Column:
    """Role, terms, form of the answer and constraints if there are any, an empty line between."""
    section = F.concat(F.lit("<SystemRole>\n"), role, F.lit("\n</SystemRole>"))
    return F.concat_ws("\n\n", section, xml_section("Terms", terms), F.lit(output_format), F.when(F.size(constraints) > 0, xml_section("Constraints", constraints)))


def deployment(config: DataFrame, deployed: DataFrame) -> DataFrame:
    """(model, action): models to create and, where they are there already, to update."""
    create = config.join(deployed, "model", "left_anti").select("model", F.lit("create").alias("action"))
    return create.unionByName(config.join(deployed, "model", "left_semi").select("model", F.lit("update").alias("action")))
