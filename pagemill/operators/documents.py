"""Corrected documents as JSON: parsing, numbers, order, missing questions; prompts and payloads for a language model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import geometry

ITEM = "struct<no:string,type:string,prompt_en:string,options:array<string>,tokens:array<string>,student_answer:string,notes:string>"
#: What a question added by rule says of itself (fixed value).
ADDED = "auto_added_missing_question_from_pipeline"


def items(json: Column) -> Column:
    """The items of a document; null for what isn't JSON, empty where there are none."""
    parsed = F.from_json(json, f"struct<items:array<{ITEM}>>", {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(json).isNotNull(), F.coalesce(parsed["items"], F.array().cast(f"array<{ITEM}>")))


def number(no: Column) -> Column:
    return no.try_cast("int")


def item_numbers(json: Column) -> Column:
    """The distinct numbers of a document's items, ascending."""
    of = F.transform(F.coalesce(items(json), F.array().cast(f"array<{ITEM}>")), lambda x: number(x["no"]))
    return F.array_sort(F.array_distinct(F.array_compact(of)))


def missing_numbers(expected: Column, json: Column) -> Column:
    return F.array_sort(F.array_except(expected, item_numbers(json)))


def by_number(array: Column) -> Column:
    """Items by number, those without one last; ties keep their order."""
    keyed = F.transform(array, lambda x, i: F.struct(F.coalesce(number(x["no"]), F.lit(10**9)).alias("n"), i.alias("i"), x.alias("item")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)), lambda x: x["item"])


def filled(tokens: Column) -> Column:
    return F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: T.strip(x) != "")


def add_missing(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Items (page_id, no, ...) and, for each question without one, an item by rule. The last of several of a number counts."""
    have = found.groupBy("page_id", "no").agg(F.max_by("note", "seq").alias("note"))
    gone = questions.select("page_id", F.col("question_no").alias("no")).join(have, ["page_id", "no"], "left_anti").withColumn("note", F.lit(ADDED))
    return have.unionByName(gone)


def blocks_of_lines(text: Column) -> Column:
    """Blocks b001, b002... of a text's lines; blank lines have no number."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"), lambda x: T.strip(x) != "")
    return F.transform(lines, lambda x, i: F.struct(T.block_id(i + 1).alias("id"), F.lit("printed").alias("kind"), F.lit("misc").alias("role"), x.alias("text")))


def messages(system: str, user: Column) -> Column:
    """A chat of a system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


NULLS = {"ignoreNullFields": "false"}


def payload(of: DataFrame, markers: DataFrame | None = None, source: Column | None = None) -> DataFrame:
    """What a model gets of a page: payload (JSON, nulls included), hints (JSON) and the numbers expected in the answer.

    of: `hints.hints` of a page's blocks and questions; blocks may have the column engine. Blocks without text are left out.
    markers (page_id, det_seq, label, box) follow the blocks, by the first appearance of their label.
    """
    fields = of.schema["blocks"].dataType.elementType.fieldNames()
    numbered = F.transform(F.filter("blocks", lambda b: b["stripped"] != ""), lambda b: F.struct(b.alias("b"), T.question_numbers(b["txt"]).alias("nos")))
    page = of.withColumn("_blocks", numbered)
    if markers is not None:
        m = geometry.marker_order(markers).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.array(*geometry.BOX).alias("bbox")))).alias("_markers"))
        page = page.join(m, "page_id", "left")
    none = F.array().cast("array<struct<rank:int,bbox:array<double>>>")
    marked = F.coalesce("_markers", none) if markers is not None else none

    def block(x: Column) -> Column:
        b = x["b"]
        kind = T.kind(b["engine"]) if "engine" in fields else F.lit("printed")
        box = F.array(*[b[c] for c in geometry.BOX])
        said = F.struct(b["block_id"].alias("id"), kind.alias("kind"), T.role(b["txt"]).alias("role"), b["stripped"].alias("text"), box.alias("bbox"), F.coalesce(b["conf"], F.lit(0.0)).alias("conf"), F.get(x["nos"], 0).alias("question_no"), x["nos"].alias("question_nos"))
        return F.to_json(said, NULLS)

    def mark(x: Column, i: Column) -> Column:
        said = F.struct(T.block_id(i + 1, "m").alias("id"), F.lit("mark").alias("kind"), F.lit("misc").alias("role"), F.lit("").alias("text"), x["bbox"].alias("bbox"), F.lit(None).cast("double").alias("conf"))
        return F.to_json(said, NULLS)

    asked = F.transform("questions", lambda q: F.struct(*[q[c].alias(c) for c in ("question_no", "text", "block_ids", "confidence_min", "option_candidates")]))
    first = F.array_compact(F.transform("_blocks", lambda x: F.get(x["nos"], 0)))
    expected = F.array_sort(F.array_distinct(F.concat(F.transform("questions", lambda q: q["question_no"]), first)))
    detected = F.array_sort(F.array_distinct(F.flatten(F.transform("_blocks", lambda x: x["nos"]))))
    name = F.regexp_replace(F.to_json(F.array(T.base_name(source) if source is not None else F.lit(None).cast("string")), NULLS), r"^\[|\]$", "")
    page = page.withColumn("expected_numbers", expected)
    body = F.concat(
        F.lit('{"page_no":null,"source":'), name, F.lit(',"blocks":['), F.array_join(F.concat(F.transform("_blocks", block), F.transform(marked, mark)), ","),
        F.lit('],"question_chunks":'), F.to_json(asked, NULLS), F.lit(',"expected_question_nos":'), F.to_json("expected_numbers"),
        F.lit(',"detected_question_nos_from_blocks":'), F.to_json(detected), F.lit("}"),
    )
    return page.select("page_id", body.alias("payload"), F.to_json("hints", NULLS).alias("hints"), "expected_numbers")


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], column: str = "prompt") -> DataFrame:
    """Answers of a language model: `client` makes, once a task, a function from prompt to answer. Failures become the column error.

    A null prompt isn't asked: answer and error are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for df in batches:
            answers, errors = [], []
            for p in df[column]:
                try:
                    answers.append(call(p) if isinstance(p, str) else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one page's failure is that page's row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield df.assign(answer=answers, error=errors)

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    return prompts.mapInPandas(run, schema)


#: Parts of a final document, in order (fixed values).
PARTS = ("raw_text", "raw_text_debug", "corrected", "fast_preview", "formula_map", "options", "ocr_records", "text_detection", "llama", "question_chunks")


def assembled(pages: DataFrame) -> DataFrame:
    """page_id and document: the JSON of a page's parts, nulls included. A part that pages don't have is null."""
    parts = [(F.col(c) if c in pages.columns else F.lit(None).cast("string")).alias(c) for c in PARTS]
    return pages.select("page_id", F.to_json(F.struct(*parts), NULLS).alias("document"))


def write_documents(final: DataFrame, path: str) -> None:
    """Final documents (page_id, document) as text, a line each: page_id and the document."""
    final.select(F.to_json(F.struct(F.col("page_id"), F.try_parse_json("document").alias("document")), NULLS)).write.mode("overwrite").text(path)


#: What an evaluation reads of a final document.
READ = "raw_text string, corrected string, options array<string>, formula_map map<string,string>, ocr_records array<string>"


def read_documents(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """page_id and the parts that `evaluate` reads, of what `write_documents` wrote, or of files that hold one document each.

    A missing path raises. The id of a file is a hash of its path. What isn't JSON has null parts.
    """
    if whole_files:
        found = spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("page_id"), F.from_json("value", READ).alias("d"))
    else:
        parts = ",".join(p.replace(" ", ":") for p in READ.split(", "))
        found = spark.read.schema(f"page_id long, document struct<{parts}>").json(path).select("page_id", F.col("document").alias("d"))
    return found.select("page_id", "d.*")


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation as JSON lines."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def evaluate(final: DataFrame) -> DataFrame:
    """Whether a final document has texts, and how many options, formulas and records."""

    def n(c: str) -> Column:
        return F.when(F.col(c).isNull(), 0).otherwise(F.size(c))

    def there(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    return final.select("page_id", there("raw_text").alias("has_raw_text"), there("corrected").alias("has_corrected"), n("options").alias("option_count"), n("formula_map").alias("formula_count"), n("ocr_records").alias("ocr_records"))


def polygons(found: object) -> list[list[tuple[float, float]]]:
    """Lists of four or more points, wherever they are in nested lists. What is inside a polygon isn't searched again."""
    out, left = [], [found]
    while left:
        node = left.pop()
        node = node.tolist() if hasattr(node, "tolist") else node
        if not isinstance(node, list | tuple):
            continue
        points = [p for p in node if isinstance(p, list | tuple) and len(p) >= 2 and all(isinstance(v, int | float) for v in p[:2])]
        if len(node) >= 4 and len(points) == len(node):
            out.append([(float(p[0]), float(p[1])) for p in points])
        else:
            left.extend(reversed(node))
    return out


#: An option must be this like what the context says; or as like as the second number if that is clear of the next option.
SURE, LIKELY, CLEAR, LONG_ENOUGH = 0.78, 0.66, 0.08, 4
#: Spans of options, taken out one kind after the other: what one kind takes may open or close another (fixed values).
_SPANS = tuple(re.compile(p) for p in (r"\[[^\]\n]{1,160}[\]}]", r"\{[^}\n]{1,160}[}\]]", r"\([^)\n]{1,160}\)"))
_WORD = re.compile(r"[0-9A-Za-z가-힣]+")


def answer_of(options: list[str], context: str | None) -> str | None:
    """The option that the context says outside of brackets, as it is or nearly; None if that isn't clear."""
    outside = context or ""
    for span in _SPANS:
        outside = span.sub(" ", outside)
    said = _WORD.findall(outside.lower())
    runs = ["".join(said[i : i + n]) for i in range(len(said)) for n in (1, 2, 3) if i + n <= len(said)]
    scored = []
    for option in options if said else []:
        key = "".join(_WORD.findall(option.lower()))
        if key:
            like = 1.0 if key in "".join(said) else max(SequenceMatcher(None, key, r).ratio() for r in runs)
            scored.append((like, key, option))
    if not scored:
        return None
    scored.sort(key=lambda x: -x[0])
    like, key, option = scored[0]
    next_best = scored[1][0] if len(scored) > 1 else 0.0
    sure = like >= SURE or (len(key) >= LONG_ENOUGH and like >= LIKELY and like - next_best >= CLEAR)
    return option if sure else None


def _item(question: dict, answer: str | None, note: str) -> dict:
    return {
        "no": question["question_no"], "type": "other", "instruction_ko": None, "prompt_en": question["text"], "options": question["options"], "tokens": [], "student_answer": answer,
        "teacher_marks": {"symbols": [], "selected_option": answer, "is_correct": None},
        "evidence": {"block_ids": question["block_ids"], "confidence_min": question["confidence_min"]}, "notes": note,
    }


def fallback_document(found: list[dict], source: str = "photo") -> str:
    """A document of the questions alone, for when no model answered."""
    some = [_item(q | {"text": (q["text"] or "").strip() or None}, answer_of(q["options"], q["context_text"]), "fallback_structured_from_ocr") for q in sorted(found, key=lambda q: q["question_no"])]
    # keys and texts are fixed values
    return json.dumps({"doc_type": "english_workbook_page", "page_meta": {"source": source, "page_no": None}, "items": some, "notes": "llm_unavailable_or_failed"}, ensure_ascii=False, indent=2)


def _noted(item: dict, note: str) -> None:
    old = item.get("notes")
    if not isinstance(old, str):
        item["notes"] = note
    elif note not in old:
        item["notes"] = f"{old}; {note}".strip("; ")


def _locked(item: dict, question: dict) -> None:
    """What the page itself says takes the place of what a model made of it."""
    evidence = item["evidence"] if isinstance(item.get("evidence"), dict) else {}
    item["evidence"] = evidence | {"block_ids": question["block_ids"], "confidence_min": question["confidence_min"]}
    own, said = (question["text"] or "").strip(), str(item.get("prompt_en") or "").strip()
    if own and (not said or SequenceMatcher(None, "".join(said.split()), "".join(own.split())).ratio() < 0.8):
        item["prompt_en"] = own
        _noted(item, "prompt_locked_from_ocr")
    options = question["options"]
    if not options:
        return

    def listed(name: str) -> list[str]:
        v = item.get(name)
        return [str(x) for x in v if str(x).strip()] if isinstance(v, list) else []

    if listed("options") != options:
        item["options"] = options
        _noted(item, "options_locked_from_ocr")
    if str(item.get("type") or "").lower() == "reorder_words" and not listed("tokens"):
        item["tokens"] = options
    if not str(item.get("student_answer") or "").strip() and (answer := answer_of(options, question["context_text"])):
        item["student_answer"] = answer
        marks = item["teacher_marks"] = item["teacher_marks"] if isinstance(item.get("teacher_marks"), dict) else {}
        if not str(marks.get("selected_option") or "").strip():
            marks["selected_option"] = answer
        _noted(item, "student_answer_inferred_from_ocr")


def repaired_document(corrected: str | None, found: list[dict]) -> str | None:
    """A model's document with evidence, prompts and options of the page's questions, missing ones added, by number.

    What isn't a JSON object with a list of items stays as it is.
    """
    try:
        data = json.loads(corrected) if corrected and found else None
    except json.JSONDecodeError:
        data = None
    if not isinstance(data, dict) or not isinstance(data.get("items"), list):
        return corrected
    of = {x["no"]: x for x in data["items"] if isinstance(x, dict) and isinstance(x.get("no"), int)}
    for q in found:
        if q["question_no"] in of:
            _locked(of[q["question_no"]], q)
        else:
            data["items"].append(_item(q, None, ADDED))

    def place(item: object) -> int:
        try:
            return int(item.get("no"))
        except (AttributeError, TypeError, ValueError):
            return 10**9

    data["items"].sort(key=place)
    return json.dumps(data, ensure_ascii=False, indent=2)


def finish(corrected: DataFrame, questions: DataFrame) -> DataFrame:
    """page_id and the final document: a model's answer repaired, or the questions alone where there is none."""
    q = questions.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("question_no", "text", "block_ids", "confidence_min", F.col("option_candidates").alias("options"), "context_text"))), {"ignoreNullFields": "false"}).alias("questions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [json.loads(x) if isinstance(x, str) else [] for x in df["questions"]]
            out = [repaired_document(c, f) if isinstance(c, str) and c else fallback_document(f) for c, f in zip(df["corrected"], found, strict=True)]
            yield pd.DataFrame({"page_id": df["page_id"], "document": out})

    return corrected.select("page_id", "corrected").join(q, "page_id", "left").mapInPandas(run, "page_id long, document string")
