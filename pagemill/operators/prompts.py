"""Prompts and chats for a language model that corrects recognised pages, its answers, and what a request says besides.

Settings are dictionaries: a template's come first, the caller's win, those of a stage win over both. Prompts are column
expressions over a page's payload; only pretty-printing of JSON needs Python, on Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents

# Fixed values from here to the end of FALLBACK_NOTE: texts that models get, settings' defaults, and lengths that are kept.
DOMAIN, STYLE = "general OCR", "concise"
CONSTRAINTS = ("Preserve original meaning", "Do not add new facts", "Fix only OCR mistakes and spacing")
BASIC_SCHEMA = '{"corrected_text":"string","notes":["string"]}'
WORKBOOK_SYSTEM = """You are an OCR post-processor for Korean school English workbook photos.
Your job is to convert OCR blocks into clean, structured JSON for downstream parsing.

Rules:
- Output MUST be valid JSON that matches the schema given by the user. Output JSON ONLY.
- Do NOT hallucinate or invent missing text. If unsure, use null or empty string and write a short reason in notes.
- Preserve original language and punctuation. Do not translate unless requested.
- Keep reading order using the given blocks order. Do not reorder across questions.
- Separate printed text vs handwriting vs teacher marks if indicated in input.
- Keep blanks as "___".
- If circles/check/X marks are detected, record them in teacher_marks without guessing correctness.
- For Korean text, preserve valid Hangul syllables. If OCR splits jamo (e.g., ㄱ ㅏ), recombine only when deterministic.
"""
WORKBOOK_SCHEMA = """{
  "doc_type": "english_workbook_page",
  "page_meta": {
    "source": "photo",
    "page_no": integer|null
  },
  "items": [
    {
      "no": integer,
      "type": "choose_correct" | "fill_blank" | "reorder_words" | "other",
      "instruction_ko": string|null,
      "prompt_en": string|null,
      "options": [string],
      "tokens": [string],
      "student_answer": string|null,
      "teacher_marks": {
        "symbols": [ "circle" | "check" | "x" | "v" | "star" | "underline" | "strike" | "highlight" ],
        "selected_option": string|null,
        "is_correct": true|false|null
      },
      "evidence": {
        "block_ids": [string],
        "confidence_min": number|null
      },
      "notes": string|null
    }
  ],
  "notes": string|null
}"""
CLASSIFICATION = (
    "choose_correct: sentence with multiple options where one may be circled/checked",
    "fill_blank: sentence with blanks and student-filled words",
    "reorder_words: token boxes that must be rearranged",
    "other: anything else",
)
EXTRACTION = (
    "Group blocks by question number patterns like 107., 108., 113.",
    "instruction_ko: Korean instruction line if present",
    "prompt_en: English sentence with blanks as ___",
    "options: parenthesis/bracket options in order",
    "tokens: word tiles for reorder_words",
    "student_answer: handwriting near each item",
    "teacher_marks: record symbols; do not guess correctness",
    "evidence.block_ids: include block ids used for each item",
    "evidence.confidence_min: minimum conf among used blocks if available",
    "For Korean strings, keep Hangul syllables normalized; if uncertain jamo composition exists, keep raw text and add notes",
)
HINT_RULES = (
    "Use rewrite_hints only when context clearly matches.",
    "Use token_replacements only when surrounding words support it.",
    "unresolved_lines/unresolved_tokens must be resolved only from nearby question context.",
    "Never paraphrase or rewrite options; keep OCR option candidates verbatim.",
    "If uncertain, keep raw OCR text and explain briefly in notes.",
)
DEFAULTS = {"model": "llama3.1:8b", "temperature": 0.2, "max_tokens": 256}
RECOVERY = "Rewrite the response as strict JSON only. Schema: {schema}.\n\nPrevious response:\n"
COVERAGE = (
    "Rewrite the JSON to include ALL required question numbers in items.no.\nRequired numbers: ",
    "\nMissing numbers: ",
    '\nDo not hallucinate details; use type="other" and short notes when unclear.\n\nCurrent JSON:\n',
)
FALLBACK_NOTE, WORKBOOK_KEPT, BASIC_KEPT = "json_parse_failed", 200, 240


def read_config(path: str) -> dict:
    """A YAML file's settings; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def settings(config: dict | None, template: dict | None = None, stage: dict | None = None) -> dict:
    """One dictionary; later ones win, key by key."""
    return {**(template or {}), **(config or {}), **(stage or {})}


def with_template(config: dict | None) -> dict:
    """Settings over those of the file that they name as prompt_template, if any."""
    path = (config or {}).get("prompt_template")
    return settings(config, read_config(path) if path else None)


def indented(text: str | None) -> str | None:
    """JSON with indents of two; null for what isn't JSON."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2) if text is not None else None
    except json.JSONDecodeError:
        return None


def with_indents(df: DataFrame, *columns: str) -> DataFrame:
    """df with the JSON of columns indented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: pa.array([indented(x) for x in batch.column(c).to_pylist()], batch.schema.field(c).type) for c in columns}
            yield pa.RecordBatch.from_arrays([held.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def _rules(lines: tuple | list) -> str:
    return "\n".join(f"- {x}" for x in lines if x)


def basic(text: Column, config: dict) -> Column:
    """Asks for a text to be corrected."""
    head = f"You are an OCR post-processing specialist.\nDomain: {config.get('domain', DOMAIN)}\nStyle: {config.get('style', STYLE)}\nRules:\n{_rules(config.get('constraints', CONSTRAINTS))}\n"
    if config.get("output_mode", "text") == "json":
        head += f"\nReturn JSON only with this schema:\n{BASIC_SCHEMA}\n"
    if config.get("extra_instructions"):
        head += f"\nExtra instructions:\n{config['extra_instructions']}\n"
    return F.concat(F.lit(f"{head}\n[OCR]\n"), F.coalesce(text, F.lit("")), F.lit("\n\n[OUTPUT]\n"))


def workbook(payload: Column, hints: Column, expected: Column, config: dict, draft: Column | None = None) -> Column:
    """Asks for a page's payload as structured items: schema, rules, numbers that must be there, draft, hints and input.

    payload and hints are indented JSON, hints or a draft may be null or empty; expected is an array of numbers.
    """
    head = (
        f"Convert the following OCR result into JSON.\n\n### Target JSON Schema (strict)\n{config.get('target_schema_text', WORKBOOK_SCHEMA)}\n\n"
        f"### Classification rules\n{_rules(config.get('classification_rules', CLASSIFICATION))}\n\n### How to extract\n{_rules(config.get('extraction_rules', EXTRACTION))}\n\n"
    )
    numbers = F.array_join(F.transform(expected, lambda n: n.cast("string")), ", ")
    coverage = F.concat(F.lit("### Mandatory coverage\n- You MUST include every question number in items.no: ["), numbers, F.lit(']\n- If a question is unclear, still include it with type="other" and a short notes field.\n\n'))
    parts = [F.lit(head), F.when(F.size(expected) > 0, coverage).otherwise("")]
    if draft is not None:
        said = F.concat(F.lit("### Fast model draft (reference only)\n"), draft, F.lit("\n\nUse the draft only as a hint. Fix errors and output final JSON only.\n\n"))
        parts.append(F.when(F.coalesce(draft, F.lit("")) != "", said).otherwise(""))
    shown = F.concat(F.lit(f"### OCR cleanup hints (apply conservatively)\n{_rules(HINT_RULES)}\n"), hints, F.lit("\n\n"))
    parts += [F.coalesce(shown, F.lit("")), F.lit("### Input (ordered OCR blocks)\n"), payload, F.lit("\n")]
    return F.concat(*parts)


def plain_payload(text: Column) -> Column:
    """The payload of a text alone: its lines as blocks."""
    none = F.lit(None).cast("string")
    blocks = F.transform(documents.blocks_of_lines(text), lambda b: b.withField("bbox", none).withField("conf", none))
    return F.to_json(F.struct(none.alias("page_no"), blocks.alias("blocks")), {"ignoreNullFields": "false"})


def messages(pages: DataFrame, config: dict, draft: str | None = None) -> DataFrame:
    """pages with the column messages: a chat, an array of role and content.

    pages has text, and for the mode `workbook_json` payload, hints and expected_numbers, as `documents.payload` gives them; a
    page without payload is asked for by its text's lines. Without that mode a chat begins with a system message only if the
    settings have one.
    """
    shown = F.col(draft) if draft else None
    if str(config.get("prompt_mode", "basic")).lower() == "workbook_json":
        shaped = with_indents(pages.withColumns({"_payload": F.coalesce("payload", plain_payload(F.col("text"))), "_hints": F.col("hints").cast("string")}), "_payload", "_hints")
        expected = F.coalesce("expected_numbers", F.array().cast("array<int>"))
        chat = documents.messages(config.get("system_prompt", WORKBOOK_SYSTEM), workbook(F.col("_payload"), F.col("_hints"), expected, config, shown))
        return shaped.withColumn("messages", chat).drop("_payload", "_hints")
    prompt = basic(F.col("text"), config)
    if shown is not None:
        more = F.concat(F.lit("\nFast model draft:\n"), shown, F.lit("\n\nUse draft only as hint and output final answer.\n"))
        prompt = F.concat(prompt, F.when(F.coalesce(shown, F.lit("")) != "", more).otherwise(""))
    if config.get("system_prompt"):
        return pages.withColumn("messages", documents.messages(config["system_prompt"], prompt))
    return pages.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))


def caller(client: Callable[[], object], config: dict) -> Callable[[], Callable[[str], str]]:
    """What `documents.ask` takes: makes a client once a task and calls it with the settings' model, temperature, length and format.

    The client has chat(model, messages, ...) and generate(model, prompt, ...). A prompt that is a JSON array is a chat; any
    other is a user's message, or generated from directly where the settings say so.
    """
    options = {"temperature": float(config.get("temperature", DEFAULTS["temperature"])), "max_tokens": int(config.get("max_tokens", DEFAULTS["max_tokens"])), "output_format": "json" if config.get("output_mode", "text") == "json" else None}
    model, chat = config.get("model", DEFAULTS["model"]), bool(config.get("use_chat", True))

    def make() -> Callable[[str], str]:
        with_model = client()

        def call(prompt: str) -> str:
            if prompt.startswith('[{"role":'):
                return with_model.chat(model, json.loads(prompt), **options)
            if chat:
                return with_model.chat(model, [{"role": "user", "content": prompt}], **options)
            return with_model.generate(model, prompt, **options)

        return call

    return make


def fallback(raw: Column, config: dict) -> Column:
    """A document in place of an answer that isn't JSON, in the shape that the settings' mode asks for, with the answer's beginning."""
    if str(config.get("prompt_mode", "")).lower() == "workbook_json":
        note = F.concat(F.lit(f"{FALLBACK_NOTE}: "), F.substring(raw, 1, WORKBOOK_KEPT))
        none = F.lit(None).cast("string")
        body = F.struct(F.lit("english_workbook_page").alias("doc_type"), F.struct(F.lit("photo").alias("source"), none.alias("page_no")).alias("page_meta"), F.array().cast("array<string>").alias("items"), note.alias("notes"))
    else:
        body = F.struct(F.lit("").alias("corrected_text"), F.array(F.lit(FALLBACK_NOTE), F.substring(raw, 1, BASIC_KEPT)).alias("notes"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def as_json(answered: DataFrame, client: Callable[[], Callable[[str], str]], config: dict) -> DataFrame:
    """Answers as pretty JSON where the settings want JSON, else as they are.

    What isn't JSON is asked for once more; if that isn't either, a fallback takes its place. Null answers stay.
    """
    if config.get("output_mode", "text") != "json":
        return answered
    schema = config.get("target_schema_text", BASIC_SCHEMA)
    bad = F.try_parse_json("answer").isNull() & F.col("answer").isNotNull()
    first = answered.withColumn("_prompt", F.when(bad, F.concat(F.lit(RECOVERY.replace("{schema}", schema)), F.col("answer")))).withColumnsRenamed({"answer": "_answer", "error": "_error"})
    second = documents.ask(first, client, "_prompt")
    again = F.coalesce("answer", F.lit(""))
    chosen = F.when(F.col("_prompt").isNull(), F.col("_answer")).when(F.try_parse_json("answer").isNotNull(), F.col("answer")).otherwise(fallback(again, config))
    error = F.coalesce("error", "_error") if "error" in answered.columns else F.col("error")
    return with_indents(second.withColumns({"answer": chosen, "error": error}).drop("_prompt", "_answer", "_error"), "answer")


def with_all_numbers(answered: DataFrame, client: Callable[[], Callable[[str], str]], config: dict) -> DataFrame:
    """Answers (and expected_numbers) that lack numbers are asked for once more, then made JSON."""
    gone = documents.missing_numbers(F.col("expected_numbers"), F.col("answer"))
    listed = [F.concat(F.lit("["), F.array_join(F.transform(c, lambda n: n.cast("string")), ", "), F.lit("]")) for c in (F.col("expected_numbers"), gone)]
    prompt = F.when(F.size(gone) > 0, F.concat(F.lit(COVERAGE[0]), listed[0], F.lit(COVERAGE[1]), listed[1], F.lit(COVERAGE[2]), F.col("answer")))
    first = answered.withColumn("_asked", prompt).withColumnsRenamed({"answer": "_kept", "error": "_failed"})
    second = as_json(documents.ask(first, client, "_asked"), client, settings(config, stage={"output_mode": "json"}))
    error = F.coalesce("error", "_failed") if "error" in answered.columns else F.col("error")
    return second.withColumns({"answer": F.coalesce("answer", "_kept"), "error": error}).drop("_asked", "_kept", "_failed")


def corrected(pages: DataFrame, client: Callable[[dict], Callable[[], Callable[[str], str]]], config: dict) -> DataFrame:
    """pages with the model's answer, draft, error and the models' names.

    Two stages, if the settings enable them: a quick model's draft, then the answer of a model that is shown the draft. client
    makes, from settings, what `documents.ask` takes.
    """
    stages = config.get("stages", {})
    two = bool(stages.get("enabled", False))
    final = settings(config, stage=stages.get("final", {}) if two else None)
    out = pages
    if two:
        fast = settings(config, stage=stages.get("fast", {}))
        out = _answered(out, client(fast), fast, None).withColumnsRenamed({"answer": "draft", "error": "draft_error"})
    else:
        out = out.withColumns({"draft": F.lit(None).cast("string"), "draft_error": F.lit(None).cast("string")})
    out = _answered(out, client(final), final, "draft" if two else None)
    if str(final.get("prompt_mode", "")).lower() == "workbook_json":
        out = with_all_numbers(out, client(final), final)
    fast_model = F.lit(settings(config, stage=stages.get("fast", {})).get("model") if two else None).cast("string")
    return out.withColumns({"two_stage": F.lit(two), "fast_model": fast_model, "final_model": F.lit(final.get("model", DEFAULTS["model"] if not two else None)).cast("string")})


def _answered(pages: DataFrame, client: Callable[[], Callable[[str], str]], config: dict, draft: str | None) -> DataFrame:
    asked = messages(pages, config, draft).withColumn("_chat", F.to_json("messages")).drop("messages")
    return as_json(documents.ask(asked, client, "_chat").drop("_chat"), client, config)
