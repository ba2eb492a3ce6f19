"""What processors answer: JSON held as VARIANT, checked by columns, and the artifacts that it is stored as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the payloads of an artifact, of which it has one, and the formats of standard data
PAYLOADS = ("data_base64", "text", "json_data", "standard_data")
FORMATS = ("table", "knowledge_graph", "entity_list", "wiki_markdown")


def given(value: Column, path: str) -> Column:
    """Whether a path is there and isn't null."""
    v = F.try_variant_get(value, path, "variant")
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def texts_at(value: Column, items: str, part: str) -> Column:
    """The strings at a part of each item of a list; an empty array where there is no list."""
    found = F.coalesce(F.try_variant_get(value, items, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(found, lambda x: F.try_variant_get(x, part, "string"))


def _repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def artifact_problem(artifact: Column, enrichment: bool = True) -> Column:
    """What is wrong with an artifact (VARIANT), or null: the first of its problems.

    It must have an id, a kind and a media type, exactly one payload, and standard data of a known
    format whose ids are unique and whose references hold. Artifacts of enrichments must be standard data.
    """
    count = sum(F.when(given(artifact, f"$.{p}"), 1).otherwise(0) for p in PAYLOADS)
    s, kind = "$.standard_data", F.try_variant_get(artifact, "$.standard_data.artifact_type", "string")
    standard = given(artifact, s)
    keys, rows, origins = texts_at(artifact, f"{s}.columns", "$.key"), texts_at(artifact, f"{s}.rows", "$"), texts_at(artifact, f"{s}.row_provenance", "$")
    nodes, edges = texts_at(artifact, f"{s}.nodes", "$.id"), texts_at(artifact, f"{s}.edges", "$.id")
    ends = F.array_union(texts_at(artifact, f"{s}.edges", "$.source"), texts_at(artifact, f"{s}.edges", "$.target"))
    is_ = lambda name: standard & (kind == name)
    problem = F.when(~(given(artifact, "$.id") & given(artifact, "$.kind") & given(artifact, "$.media_type")), "id, kind and media_type are required")
    problem = problem.when(count != 1, "an artifact has exactly one payload")
    problem = problem.when(standard & ~F.coalesce(kind.isin(*FORMATS), F.lit(False)), "unknown format of standard data")
    problem = problem.when(is_("table") & _repeats(keys), "keys of columns repeat")
    problem = problem.when(is_("table") & (F.size(origins) > 0) & (F.size(origins) != F.size(rows)), "row_provenance doesn't match the rows")
    problem = problem.when(is_("knowledge_graph") & _repeats(nodes), "ids of nodes repeat").when(is_("knowledge_graph") & _repeats(edges), "ids of edges repeat")
    problem = problem.when(is_("knowledge_graph") & (F.size(F.array_except(ends, nodes)) > 0), "an edge has no node")
    problem = problem.when(is_("entity_list") & _repeats(texts_at(artifact, f"{s}.entities", "$.id")), "ids of entities repeat")
    return problem.when(~standard, "an enrichment has standard data") if enrichment else problem


def parsed(responses: DataFrame, body: str = "body") -> DataFrame:
    """The responses with answer (VARIANT; null where the body isn't JSON) in place of their body."""
    return responses.withColumn("answer", F.try_parse_json(body)).drop(body)


def response_problems(answers: DataFrame, key: str = "request_id", enrichment: bool = True) -> DataFrame:
    """key, place (from 1; 0: the response as a whole), problem: all responses that can't be kept, and why."""
    artifacts = F.try_variant_get("answer", "$.artifacts", "array<variant>")
    ids = texts_at(F.col("answer"), "$.artifacts", "$.id")
    least = F.coalesce(F.size(artifacts), F.lit(0)) < (1 if enrichment else 0)
    whole = F.when(F.col("answer").isNull(), "the body isn't JSON").when(F.try_variant_get("answer", "$.api_version", "string") != "v1", "another version of the contract")
    whole = whole.when(least, "no artifacts").when(_repeats(ids), "ids of artifacts repeat")
    of_all = answers.select(key, F.lit(0).alias("place"), whole.alias("problem"))
    each = answers.select(key, F.posexplode(artifacts).alias("p", "artifact")).select(key, (F.col("p") + 1).alias("place"), artifact_problem(F.col("artifact"), enrichment).alias("problem"))
    return of_all.unionByName(each).where("problem IS NOT NULL")


def stored_artifacts(answers: DataFrame, problems: DataFrame, key: str = "request_id") -> DataFrame:
    """The artifacts of responses without a problem, as the store takes them: scope_type, scope_id, kind, method, payload, metadata, written.

    answers holds key, scope_type, scope_id, processor, version, url, written and answer. The payload is the
    standard data, else the JSON, else the text as {"text": ...}. A processor that answers with several artifacts
    writes a method for each: its name, a dot, and the id or else the place.
    """
    good = answers.join(problems.select(key).distinct(), key, "left_anti")
    items = F.try_variant_get("answer", "$.artifacts", "array<variant>")
    rows = good.select(key, "scope_type", "scope_id", "processor", "version", "url", "written", F.size(items).alias("_n"), F.posexplode(items).alias("_p", "_a"))
    a = F.col("_a")
    text = lambda path: F.to_json(F.try_variant_get(a, path, "variant"))
    plain = F.to_json(F.struct(F.try_variant_get(a, "$.text", "string").alias("text")))
    payload = F.when(given(a, "$.standard_data"), text("$.standard_data")).when(given(a, "$.json_data"), text("$.json_data")).otherwise(plain)
    id_ = F.try_variant_get(a, "$.id", "string")
    method = F.when(F.col("_n") == 1, F.col("processor")).otherwise(F.concat_ws(".", "processor", F.coalesce(F.nullif(id_, F.lit("")), (F.col("_p") + 1).cast("string"))))
    metadata = F.to_json(F.struct(id_.alias("artifact_id"), F.col("processor").alias("method"), "version", F.col("url").alias("processor_url")))
    kind = F.coalesce(F.nullif(F.try_variant_get(a, "$.kind", "string"), F.lit("")), F.lit("enrichment"))
    return rows.select("scope_type", "scope_id", kind.alias("kind"), method.alias("method"), payload.alias("payload"), metadata.alias("metadata"), "written")


def payload_schema(answers: DataFrame, path: str = "$.artifacts[0].standard_data") -> str | None:
    """The schema that the values at a path have in common, from one aggregate over all answers."""
    return answers.agg(F.schema_of_variant_agg(F.try_variant_get("answer", path, "variant")).alias("s")).first()["s"]
