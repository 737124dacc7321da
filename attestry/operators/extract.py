"""Facts out of page text: lines, their metric, amount and period, the first of each kept. No Python code runs on rows."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import concept as C
from ..functions import find
from ..functions import lexicon as L
from ..functions.text import first_match, let
from ..functions.value import normalize_value

#: Pages whose text may name the document's period, and lines of the first page that may name its entity.
PERIOD_PAGES, ENTITY_LINES, LEAST_CHARS = 3, 15, 8


def lines(pages: DataFrame) -> DataFrame:
    """`pages` (doc_id, page_ord, page_number, text, ...) cut at \\n: their key columns, line_no, and line, trimmed and of LEAST_CHARS characters or more."""
    cut = pages.select("doc_id", "page_ord", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return cut.withColumn("line", find.trimmed(F.col("line"))).filter(F.length("line") >= LEAST_CHARS)


def documents(pages: DataFrame) -> DataFrame:
    """(doc_id, doc_pos, document_name, entity, doc_period): one row for each document, from its first pages."""
    first = pages.filter(F.col("page_ord") < PERIOD_PAGES)
    told = first.select("doc_id", "doc_pos", "document_name", "page_ord", *_named())
    own = told.groupBy("doc_id").agg(F.min("doc_pos").alias("doc_pos"), F.min("document_name").alias("document_name"), F.min("e").alias("e"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("page_ord"))).alias("p"))
    return own.select("doc_id", "doc_pos", "document_name", F.coalesce("e", find.entity_of_file(F.col("document_name"))).alias("entity"), F.coalesce("p", F.lit(L.UNKNOWN_PERIOD)).alias("doc_period"))


def extract_facts(pages: DataFrame) -> DataFrame:
    """Facts of `pages` (doc_id, doc_pos, document_name, page_ord, page_number, text) by rules.

    Of one page number, metric and period the first line with an amount counts. Columns: fact_id, doc_id, doc_pos,
    fact_no (1-based in the document), document_name, page_number, entity, metric, category, raw_value,
    period, scope, basis, operations, audit_status, evidence, statement, confidence, currency and unit (what the amount
    itself says), notes (null: rules make none). Pages without text have none.
    """
    found = lines(pages).select("*", F.explode(_stated()).alias("f")).select("doc_id", "page_ord", "page_number", "line_no", "line", "f.*")
    found = found.join(documents(pages), "doc_id").withColumn("period", F.coalesce("line_period", "doc_period"))
    key = ["doc_id", "page_number", "metric", "period"]
    rest = ["page_ord", "line_no", "line", "category", "raw_value", "doc_pos", "document_name", "entity"]
    first = found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("f")).select(*key, "f.*")
    first = first.withColumn("fact_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord", "line_no"))).select("*", *_around())
    return first.select(
        F.concat("doc_id", F.lit("_p"), F.col("page_number").cast("string"), F.lit("_f"), F.col("fact_no").cast("string")).alias("fact_id"),
        "doc_id", "doc_pos", "fact_no", "document_name", "page_number", "entity", "metric", "category", "raw_value", "period",
        F.coalesce("c.scope", F.lit("Consolidated")).alias("scope"), "c.basis", "c.operations", "c.audit_status",
        F.regexp_replace("line", r"^[-•*]\s*", "").alias("evidence"), _statement().alias("statement"), F.lit(0.85).alias("confidence"),
        F.col("v.currency").alias("currency"), F.col("v.unit").alias("unit"), F.lit(None).cast("string").alias("notes"),
    )


@cache
def _stated() -> Column:
    """What a line states: an array of one, or none. One expression, so that no rule is tried twice: where a line's metric is found, the rest is looked for."""
    told = let({"metric": find.metric_in(F.col("line"))}, lambda m: F.when(m.metric.isNotNull(), let({"metric": m.metric, "category": C.category(m.metric)}, _told)))
    return F.filter(F.array(told), lambda f: f.raw_value.isNotNull())


@cache
def _around() -> list[Column]:
    return [C.context(F.lower("line")).alias("c"), normalize_value(F.col("raw_value"), F.col("line")).alias("v")]


@cache
def _named() -> list[Column]:
    """Of a page the period that its text names, and of a first page the entity."""
    head = F.slice(F.filter(F.transform(F.split("text", "\n"), find.trimmed), lambda x: x != ""), 1, ENTITY_LINES)
    named = F.get(F.filter(F.transform(head, find.entity_in_line), lambda e: e.isNotNull()), F.lit(0))
    return [find.find_period(F.col("text")).alias("p"), F.when(F.col("page_ord") == 0, named).alias("e")]


def _told(x: Column) -> Column:
    line = F.col("line")
    return F.struct(x.metric.alias("metric"), x.category.alias("category"), find.value_in(line, x.metric, x.category).alias("raw_value"), find.find_period(line).alias("line_period"))


def _statement() -> Column:
    basis = F.when(F.col("c.basis").isNotNull(), F.concat(F.lit(" on a "), F.col("c.basis"), F.lit(" basis"))).otherwise(F.lit(""))
    return F.concat("entity", F.lit(" reported "), "metric", F.lit(" of "), "raw_value", F.lit(" for "), "period", basis, F.lit("."))


def prioritised_keys(pages: DataFrame, keep: int = L.MODEL_PAGES) -> DataFrame:
    """(doc_id, page_ord) of the pages of each document that a model is shown: all up to `keep`; of more, the first `keep` with data, or the first `keep` if fewer than three have any.

    Texts are looked at where they are read and don't travel: of each document at most `keep` pages with data and as many
    without leave a task, then a task for each document sees those alone. page_ord is taken to be unique in a document.
    """
    has = F.coalesce(F.rlike("text", F.lit(f"(?i){L.DATA_WORDS}")), F.lit(False))
    flags = pages.select("doc_id", "page_ord", has.alias("has"))
    counts = flags.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("has").alias("n_with"))
    kind = Window.partitionBy("doc_id", "has").orderBy("page_ord")
    first = flags.withColumn("rank", F.row_number().over(kind)).filter(F.col("rank") <= keep)  # cut before the exchange, too
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord"))
    told = first.withColumn("at", at).join(counts, "doc_id")
    return told.filter((F.col("n") <= keep) | F.when(F.col("n_with") >= 3, F.col("has")).otherwise(F.col("at") <= keep)).select("doc_id", "page_ord")


def prioritised_pages(pages: DataFrame, keep: int = L.MODEL_PAGES) -> DataFrame:
    """The pages that prioritised_keys() names, with all their columns."""
    return pages.join(prioritised_keys(pages, keep), ["doc_id", "page_ord"], "left_semi").select(*pages.columns)


def prompts(pages: DataFrame, chars: int = L.MODEL_CHARS) -> DataFrame:
    """(doc_id, prompt): the prioritised pages' first characters under page headers."""
    part = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    return prioritised_pages(pages).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", part.alias("part")))), lambda x: x.part), "\n\n").alias("prompt"))


MODEL_FACT = "array<struct<pageNumber:int,entity:string,metric:string,category:string,rawValue:string,evidenceText:string,statement:string,period:string,basis:string,scope:string,notes:string>>"


def model_facts(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts of a model's answers (doc_id, payload: a JSON array, untrusted), with defaults for what they leave out.

    Documents whose payload is null, empty or no array get the facts that rules find, with mode `rules`; the others
    have mode `model`. Page numbers are held to the document's pages, unknown categories become general.
    """
    docs = pages.groupBy("doc_id").agg(F.min("doc_pos").alias("doc_pos"), F.min("document_name").alias("document_name"), F.count("*").alias("n_pages"))
    read = answers.select("doc_id", F.from_json("payload", MODEL_FACT).alias("rows")).filter(F.size(F.filter("rows", lambda r: r.isNotNull())) > 0)
    rows = read.join(docs, "doc_id").select("doc_id", "doc_pos", "document_name", "n_pages", F.posexplode(F.filter("rows", lambda r: r.isNotNull())).alias("i", "r"))
    given = lambda c, default: F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.lit(default))
    own = rows.withColumn("x", F.lower(F.concat_ws(" ", "r.evidenceText", "r.metric", "r.notes"))).withColumn("c", C.context(F.col("x"))).withColumn("v", normalize_value(F.col("r.rawValue"), F.col("r.evidenceText")))
    by_model = own.select(
        F.concat("doc_id", F.lit("_p"), F.coalesce(F.col("r.pageNumber").cast("string"), F.lit("1")), F.lit("_f"), (F.col("i") + 1).cast("string")).alias("fact_id"),
        "doc_id", "doc_pos", (F.col("i") + 1).alias("fact_no"), "document_name",
        F.greatest(F.lit(1), F.least(F.coalesce(F.nullif("r.pageNumber", F.lit(0)), F.lit(1)), F.col("n_pages").cast("int"))).alias("page_number"),
        given("entity", "General").alias("entity"), given("metric", "Metric").alias("metric"),
        F.when(F.lower("r.category").isin(*L.FACT_CATEGORIES), F.lower("r.category")).otherwise("general").alias("category"),
        given("rawValue", "").alias("raw_value"), given("period", "Unspecified").alias("period"), given("scope", "Consolidated").alias("scope"),
        F.coalesce(F.nullif("r.basis", F.lit("")), "c.basis").alias("basis"), "c.operations", "c.audit_status", given("evidenceText", "").alias("evidence"),
        F.coalesce(F.nullif("r.statement", F.lit("")), F.concat_ws(": ", "r.metric", given("rawValue", ""))).alias("statement"), F.lit(0.95).alias("confidence"),
        find.scope_detail(F.col("x")).alias("scope_detail"), "c.geography", "c.is_estimate", "c.gross_or_net", find.qualifiers(F.col("x")).alias("qualifiers"), F.lit("model").alias("mode"),
        F.col("v.currency").alias("currency"), F.col("v.unit").alias("unit"), F.nullif("r.notes", F.lit("")).alias("notes"),
    )
    rules = extract_facts(pages.join(read.select("doc_id"), "doc_id", "left_anti")).withColumn("mode", F.lit("rules"))
    return by_model.unionByName(rules, allowMissingColumns=True)


#: Why rules took a document's place in the model's, by what is known of its answer (`problem`), and of an answer that came.
NOTICES = {"no_key": "Facts by rules: no key for a model is set.", "exhausted": "Facts by rules: the models' quota is used up.", "error": "Facts by rules: the model gave no answer.", "empty": "Facts by rules: the model's answer held no facts."}
NO_NOTICE = "Facts by rules."


def extraction_status(pages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_pos, mode, notice) of every document of `pages`, those without facts too.

    mode is `model` where its answer (doc_id, payload, and problem: a key of NOTICES, if known) holds facts, else `rules`
    with a notice: of the problem, of an empty or malformed answer, or of none at all. Without `answers` no key is set.
    """
    docs = pages.groupBy("doc_id").agg(F.min("doc_pos").alias("doc_pos"))
    if answers is None:
        return docs.select("doc_id", "doc_pos", F.lit("rules").alias("mode"), F.lit(NOTICES["no_key"]).alias("notice"))
    problem = F.col("problem") if "problem" in answers.columns else F.lit(None).cast("string")
    told = answers.select("doc_id", F.coalesce(F.size(F.filter(F.from_json("payload", MODEL_FACT), lambda r: r.isNotNull())), F.lit(0)).alias("n"), F.col("payload").isNotNull().alias("came"), problem.alias("problem"))
    own = docs.join(told.groupBy("doc_id").agg(F.max("n").alias("n"), F.max("came").alias("came"), F.min("problem").alias("problem")), "doc_id", "left")
    known = [(F.col("problem") == k, F.lit(v)) for k, v in NOTICES.items()]
    notice = first_match([(F.col("n") > 0, F.lit(None).cast("string")), *known, (F.coalesce("came", F.lit(False)), F.lit(NOTICES["empty"]))], F.lit(NOTICES["error"]))
    return own.select("doc_id", "doc_pos", F.when(F.col("n") > 0, "model").otherwise("rules").alias("mode"), notice.alias("notice"))


def extraction_summary(status: DataFrame) -> DataFrame:
    """One row (mode, notice): `rules` if any document fell back to them, with the first notice by place; no notice where none did."""
    fell = F.coalesce(F.max(F.col("mode") == "rules"), F.lit(False))
    one = status.agg(fell.alias("fell"), F.min_by("notice", F.when(F.col("notice").isNotNull(), F.col("doc_pos"))).alias("first"))
    return one.select(F.when(F.col("fell"), "rules").otherwise("model").alias("mode"), F.when(F.col("fell"), F.coalesce("first", F.lit(NO_NOTICE))).alias("notice"))
