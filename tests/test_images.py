"""Image kernels against plain versions; hints and repeated questions against examples."""

import colorsys
import json

import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import documents, hints, images, prompts, questions
from pagemill.plans import catalog


def test_red_ink_against_plain_hues():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    image[:5] = [200, 30, 30]
    image[5:8] = 120
    got = images.red_ink(image)
    for y, x in np.ndindex(40, 50):
        h, s, v = colorsys.rgb_to_hsv(*(int(c) / 255 for c in image[y, x]))
        half = h * 180
        if min(abs(half - 15.5), abs(half - 164.5), abs(s * 255 - 69.5)) > 1e-6:
            assert got[y, x] == ((half < 15.5 or half > 164.5) and s * 255 >= 69.5 and v * 255 >= 34.9)
    assert got[:5].all() and not got[5:8].any()


def test_strategies():
    image = np.full((9, 9, 3), 255, np.uint8)
    image[2:7, 2:7] = [220, 40, 160]
    image[4, 4] = [200, 20, 30]
    mask = images.red_ink(image) | (image[..., 1] == 40)
    kept = images.without_ink(image, mask)
    assert (kept[4, 4] == 20).all() and (kept[3, 3] == 40).all()
    assert (images.without_ink(image, mask, "white") == 255).all()
    assert (images.without_ink(image, mask, "preserve_text", dark=30)[3, 3] == 255).all()
    assert (images.ink_layer(image, mask)[4, 4] == [200, 20, 30]).all()
    assert (images.without_ink(image, mask, "inpaint", fill=lambda i, m: i * 0) == 0).all()


def test_specks_go():
    mask = np.zeros((12, 12), bool)
    mask[1, 1] = mask[5:8, 5:8] = True
    out = images.opened(mask, 3)
    assert not out[:4, :4].any() and out[4:9, 4:9].all() and out.sum() == 25
    assert images.opened(mask, 1) is mask


def test_crop_keeps_ink_outside_markers():
    crop = np.full((10, 20, 3), 255, np.uint8)
    crop[2:4, 2:4] = crop[2:4, 14:16] = [200, 0, 0]
    out = images.clean_crop(crop, (100, 50, 120, 60), [(100, 50, 108, 60)], strategy="white")
    assert (out[2, 2] == 255).all() and (out[2, 14] == [200, 0, 0]).all()
    assert images.clean_crop(crop, (100, 50, 120, 60), [(120, 50, 140, 60)]) is crop


def plain_regions(mask, diagonal):
    seen, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for start in zip(*np.nonzero(mask), strict=True):
        if not seen[start]:
            n += 1
            seen[start], left = n, [start]
            while left:
                y, x = left.pop()
                for a, b in steps:
                    p = y + a, x + b
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not seen[p]:
                        seen[p] = n
                        left.append(p)
    return seen, n


def test_regions_against_plain_search():
    rng = np.random.default_rng(7)
    for density in (0.0, 0.3, 0.5, 0.7, 1.0):
        mask = rng.random((23, 31)) < density
        for diagonal in (False, True):
            got, n = images.regions(mask, diagonal)
            want, m = plain_regions(mask, diagonal)
            assert n == m and len({*zip(got.ravel().tolist(), want.ravel().tolist(), strict=True)}) == m + (not mask.all())


def test_marks_in_holes_do_not_count():
    mask = np.zeros((40, 40), bool)
    mask[2:30, 2:30] = True
    mask[5:27, 5:27] = False
    mask[10:20, 10:20] = True
    assert images.mark_boxes(mask, max_ratio=1.0) == [(2.0, 2.0, 30.0, 30.0)]
    assert images.mark_boxes(mask[:0], max_ratio=1.0) == images.mark_boxes(mask & False) == []


def plain_boxes(mask):
    """Boxes of the marks that touch paper around the page, 4-connected, or its edge."""
    around = np.pad(mask, 1)
    paper, _ = plain_regions(~around, False)
    numbered, n = plain_regions(around, True)
    found = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(numbered == i)
        if any(paper[y + a, x + b] == 1 for y, x in zip(ys, xs, strict=True) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))):
            found.append((float(xs.min() - 1), float(ys.min() - 1), float(xs.max()), float(ys.max())))
    return sorted(found, key=lambda b: ((b[1] + b[3]) / 2, b[0]))


def test_runs_of_all_rows_are_found_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    masks = [rng.random((h, w)) < d for h, w, d in ((17, 23, 0.4), (1, 9, 0.5), (9, 1, 0.5), (12, 12, 0.8), (20, 20, 1.0))] + [np.kron(rng.random((6, 5)) < 0.5, np.ones((3, 4))) > 0]
    for mask in masks:
        assert images.mark_boxes(mask, 1, 1.0, 1, 1) == plain_boxes(mask)
    calls, found = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: calls.append(1) or found(x))
    assert images.mark_boxes(np.ones((200, 3), bool), max_ratio=1.0) == [(0.0, 0.0, 3.0, 200.0)]
    assert len(calls) <= 2  # marks and paper, not each row


def test_thresholds():
    plane = np.full((60, 60), 200, np.uint8)
    plane[20:40, 25:30] = 30
    dark = plane == 30
    assert (images.marks(plane, "otsu", blur=1) == dark).all()
    assert (images.marks(plane, blur=1) == dark).all()
    assert (images.smoothed(plane, 3)[0:10] == 200).all()
    assert [n for n, _ in images.variants(np.stack([plane] * 3, axis=-1), 2)] == ["base", "adaptive"]


def test_unreadable_images_are_rows(spark):
    good = b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 0, 255])
    df = spark.createDataFrame([(1, good), (2, b"GIF"), (3, None), (4, b"P6 9 9 255\n")], "page_id long, content binary")
    got = {r["page_id"]: r for r in images.apply(df, lambda i: [{"red": int(images.red_ink(i).sum())}], "red long").collect()}
    assert (got[1]["red"], got[1]["errors"]) == (1, None)
    assert all(got[i]["red"] is None and got[i]["errors"] for i in (2, 3, 4))


def test_crops(spark):
    """Boxes beyond the page, null edges, missing and unreadable images are rows with errors; the rest is cut as an array is."""
    image = np.arange(7 * 9 * 3, dtype=np.uint8).reshape(7, 9, 3)
    pages = spark.createDataFrame([(1, images.write_ppm(image), "x"), (2, b"GIF", "x")], "page_id long, content binary, errors string")
    rows = [(1, 1, 2.9, 1.0, 5.0, 4.0), (1, 2, -3.0, -2.0, 99.0, 99.0), (1, 3, 20.0, 1.0, 25.0, 3.0), (1, 4, None, 1.0, 2.0, 3.0), (2, 1, 0.0, 0.0, 1.0, 1.0), (3, 1, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.page_id, r.box_id): r for r in images.crops(pages, boxes, 1).collect()}
    assert len(got) == len(rows)
    assert (images.read_ppm(got[1, 1].crop) == image[0:5, 1:6]).all() and got[1, 1].errors is None
    assert (images.read_ppm(got[1, 2].crop) == image).all()
    assert all(got[k].crop is None and got[k].errors for k in ((1, 3), (1, 4), (2, 1), (3, 1)))
    assert images.crops(pages, boxes.limit(0)).count() == 0
    twice = {(r.page_id, r.box_id): r.crop for r in images.crops(pages, boxes, 0, lambda crop: images.prepared(crop, "gray", 2.0)).collect()}
    assert images.read_ppm(twice[1, 1]).shape == (6, 6, 3)


def plain_cubic(image, width, height):
    def weight(d):
        d = abs(d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    def weights(n, m):
        all_of = [[weight(x + 0.5 - (i + 0.5) * n / m) for x in range(n)] for i in range(m)]
        return np.array([[w / sum(row) for w in row] for row in all_of])

    wide = np.einsum("xw,hwc->hxc", weights(image.shape[1], width), image.astype(float))
    wide = np.clip(np.floor(wide + 0.5), 0, 255)
    return np.clip(np.floor(np.einsum("yh,hwc->ywc", weights(image.shape[0], height), wide) + 0.5), 0, 255)


def test_prepared_crops():
    crop = np.random.default_rng(4).integers(0, 256, (11, 13, 3), dtype=np.uint8)
    assert images.prepared(crop) is crop and images.prepared(crop, "none", 0.5) is crop
    grey = images.prepared(crop, "gray")
    assert grey.shape == crop.shape and (grey[..., 0] == images.grey(crop)).all() and (grey[..., 0] == grey[..., 2]).all()
    assert set(np.unique(images.prepared(crop, "adaptive"))) <= {0, 255}
    big = images.prepared(crop, "none", 1.7)
    assert big.shape == (18, 22, 3) and np.abs(big - plain_cubic(crop, 22, 18)).max() <= 1
    assert images.enlarged(np.full((1, 1, 3), 7, np.uint8), 3.0).tolist() == [[[7] * 3] * 3] * 3


def test_characters(spark):
    page = np.full((40, 60, 3), 240, np.uint8)
    for x, y in ((30, 4), (5, 6), (20, 25)):
        page[y : y + 9, x : x + 6] = 10
    df = spark.createDataFrame([(1, images.write_ppm(page)), (2, images.write_ppm(np.full((9, 9, 3), 240, np.uint8))), (3, b"GIF"), (4, None)], "page_id long, content binary")
    found = images.characters(df, {"blur_kernel": 1, "max_area_ratio": 1.0, "gallery_limit": 2, "gallery_columns": 1, "label_limit": 1}).orderBy("reading_rank").collect()
    assert [(r.page_id, r.x1, r.y1, r.x2, r.y2, r.det_seq, r.line_no) for r in found] == [(1, 5, 6, 11, 15, 2, 1), (1, 30, 4, 36, 13, 1, 1), (1, 20, 25, 26, 34, 3, 2)]
    assert [(r.label, r.reading_label, r.row, r.column) for r in found] == [("", "1", 0, 0), ("1", "", 1, 0), ("", "", None, None)]


def once(rows, key):
    out = {}
    for x in rows:
        out.setdefault(key(x), x)
    return list(out.values())


def plain_key(line):
    return re.sub("[^0-9A-Za-z가-힣]", "", re.sub(r"^\s*[0-9]{1,3}[.,]\s*", "", line)).lower()


def plain_best(key, known, least, band=None):
    """(match, its key, ratio): of all known lines, each compared."""
    scored = [(SequenceMatcher(None, key, k).ratio(), -i, line, k) for i, (line, k) in enumerate(known) if band is None or abs(len(k) - len(key)) <= band]
    ratio, _, line, k = max(scored, default=(0.0, 0, None, None))
    return (line, k, ratio) if ratio >= least and ratio > 0 else (None, None, ratio)


def plain_hints(blocks, asked, noisy_of, words_of):
    def lines(text, least):
        return [(x.strip(), plain_key(x.strip())) for x in text.splitlines() if x.strip() and len(plain_key(x.strip())) >= least]

    suspects = [b for b in blocks if b.suspect or (b.conf or 0) < 0.72]
    known = once([x for q in asked for x in lines(q.text, 6)] + [x for b in blocks if (b.conf or 0) >= 0.8 for x in lines(b.txt, 10)], lambda x: x[1])
    matched = [(b.block_id, line, key, *plain_best(key, known, 0.45)) for b in suspects for line, key in lines(b.txt, 6)]
    words = once([(w, plain_key(w)) for q in asked for t in (q.text, *q.option_candidates) for w in words_of[t] if len(plain_key(w)) >= 2], lambda x: x[1])
    noisy = [t for t in once([t for b in suspects for t in noisy_of[b.txt]], str.lower)[:120] if len(plain_key(t)) >= 2]
    tokens = [(t, plain_key(t), *plain_best(plain_key(t), words, 0.62, 4)) for t in noisy]
    return {
        "suspect_block_ids": [b.block_id for b in suspects][:40],
        "rewrite_hints": [(b, line, m) for b, line, _, m, _, _ in once([x for x in matched if x[3] is not None and x[4] != x[2]], lambda x: (x[2], x[4]))][:40],
        "token_replacements": [(t, m) for t, k, m, mk, _ in tokens if m is not None and mk != k][:80],
        "unresolved_lines": [(b, line) for b, line, _, m, _, _ in once([x for x in matched if x[3] is None], lambda x: (x[0], x[2]))][:60],
        "unresolved_tokens": [t for t, _, m, _, _ in tokens if m is None][:120],
        "canonical_lines": [line for line, _ in known][:40],
    }


def test_cleanup_hints_against_plain_version(spark):
    of = questions.pages(questions.diagnose(catalog._placed(spark, "/root/testdata/sf0.001")), "suspect").where("page_id % 4 = 0").cache()
    got = {r.page_id: json.loads(r.hints) for r in hints.cleanup_hints(of).collect()}
    rows = of.collect()
    texts = [(t,) for t in {t for r in rows for t in [b.txt for b in r.blocks] + [x for q in r.questions for x in (q.text, *q.option_candidates)]}]
    told = spark.createDataFrame(texts, "t string").select("t", T.noisy_tokens(F.col("t")).alias("n"), T.lexicon_tokens(F.col("t")).alias("w")).collect()
    noisy_of, words_of = {r.t: r.n for r in told}, {r.t: r.w for r in told}
    for r in rows:
        h = got[r.page_id]
        said = {
            "suspect_block_ids": h["suspect_block_ids"], "canonical_lines": h["canonical_lines"],
            "rewrite_hints": [(x["block_id"], x["raw_line"], x["suggested_line"]) for x in h["rewrite_hints"]],
            "token_replacements": [(x["raw_token"], x["suggested_token"]) for x in h["token_replacements"]],
            "unresolved_lines": [(x["block_id"], x["raw_line"]) for x in h["unresolved_lines"]],
            "unresolved_tokens": [x["raw_token"] for x in h["unresolved_tokens"]],
        }
        assert said == plain_hints(r.blocks, r.questions, noisy_of, words_of)
    assert sum(len(h["rewrite_hints"]) for h in got.values()) > 100 and sum(len(h["unresolved_tokens"]) for h in got.values()) > 0


def test_cleanup_hints(spark):
    blocks = [
        (1, 1, "b001", "the quick brown fox", 0.9, False), (1, 2, "b002", "the quick brawn f0x\nzzzz yyyy xxxx\nthe quick brawn f0x", 0.5, False), (1, 3, "b003", "qu|ck {vvvvvv", None, False),
        (2, 1, "b001", "all is well here", 0.95, False),
    ]
    b = spark.createDataFrame(blocks, "page_id long, pos int, block_id string, txt string, conf double, suspect boolean")
    q = spark.createDataFrame([(1, 1, "1. quick words", ["brown"])], "page_id long, question_no int, text string, option_candidates array<string>")
    b = b.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "txt", "conf", "suspect"))).alias("blocks"))
    q = q.groupBy("page_id").agg(F.collect_list(F.struct("question_no", "text", "option_candidates")).alias("questions"))
    none = F.array().cast(q.schema["questions"].dataType)
    got = {r["page_id"]: json.loads(r["hints"]) for r in hints.cleanup_hints(b.join(q, "page_id", "left").withColumn("questions", F.coalesce("questions", none))).collect()}
    one, two = got[1], got[2]
    assert one["canonical_lines"] == ["1. quick words", "the quick brown fox"] and one["suspect_block_ids"] == ["b002", "b003"]
    assert [(h["block_id"], h["raw_line"], h["suggested_line"]) for h in one["rewrite_hints"]] == [("b002", "the quick brawn f0x", "the quick brown fox")]
    assert [(h["block_id"], h["raw_line"]) for h in one["unresolved_lines"]] == [("b002", "zzzz yyyy xxxx"), ("b003", "qu|ck {vvvvvv")]
    assert [(h["raw_token"], h["suggested_token"]) for h in one["token_replacements"]] == [("qu|ck", "quick")]
    assert [h["raw_token"] for h in one["unresolved_tokens"]] == ["{vvvvvv"]
    assert two["suspect_block_ids"] == two["rewrite_hints"] == [] and two["canonical_lines"] == ["all is well here"] and len(two["rules"]) == 5


def echo(answers):
    """Makes a model that answers from a list of rules and raises on `bad`."""

    class Echo:
        def chat(self, model, messages, **options):
            said = messages[-1]["content"]
            if "bad" in said:
                raise ZeroDivisionError(said)
            return next((a for cue, a in answers if cue in said), "none")

        def generate(self, model, prompt, **options):
            return f"generated {model} {options['max_tokens']}"

    return Echo


def test_answers_become_json(spark):
    rows = [(1, '{"a": 1}', [1]), (2, "no json", [1]), (3, "never json", [1]), (4, None, [1]), (5, "bad", [1])]
    df = spark.createDataFrame(rows, "page_id long, answer string, expected_numbers array<int>")
    client = prompts.caller(echo([("no json", '{"b": [2]}')]), {})
    got = {r.page_id: r for r in prompts.as_json(df, client, {"output_mode": "json"}).collect()}
    assert got[1].answer == json.dumps({"a": 1}, indent=2) and json.loads(got[2].answer) == {"b": [2]} and got[4].answer is None
    assert json.loads(got[3].answer) == {"corrected_text": "", "notes": ["json_parse_failed", "none"]}
    assert got[5].error.startswith("ZeroDivisionError") and json.loads(got[5].answer)["notes"][0] == "json_parse_failed"
    [three] = prompts.as_json(df.where("page_id = 3"), client, {"output_mode": "json", "prompt_mode": "workbook_json"}).collect()
    assert json.loads(three.answer) == {"doc_type": "english_workbook_page", "page_meta": {"source": "photo", "page_no": None}, "items": [], "notes": "json_parse_failed: none"}
    assert {r.answer for r in prompts.as_json(df, client, {}).collect()} == {r[1] for r in rows}


def test_missing_numbers_are_asked_for(spark):
    rows = [(1, '{"items": [{"no": 1}]}', [1, 2]), (2, '{"items": [{"no": 1}]}', [1]), (3, '{"items": [{"no": 5}], "x": "bad"}', [1])]
    df = spark.createDataFrame(rows, "page_id long, answer string, expected_numbers array<int>")
    client = prompts.caller(echo([("Required numbers: [1, 2]\nMissing numbers: [2]\n", '{"items": [{"no": 1}, {"no": 2}]}')]), {})
    got = {r.page_id: r for r in prompts.with_all_numbers(df, client, {}).collect()}
    assert json.loads(got[1].answer)["items"][1] == {"no": 2}
    assert [got[i].answer for i in (2, 3)] == [r[1] for r in rows[1:]]
    assert got[2].error is None and got[3].error.startswith("ZeroDivisionError")


def test_two_stages(spark):
    pages = spark.createDataFrame([(1, "teh cat"), (2, "bad")], "page_id long, text string")
    config = {"model": "m", "stages": {"enabled": True, "fast": {"model": "f"}, "final": {"system_prompt": "be brief"}}}
    seen = [("Fast model draft:\nthe cat?", "the cat"), ("[OCR]\nteh cat", "the cat?")]
    got = {r.page_id: r for r in prompts.corrected(pages, lambda c: prompts.caller(echo(seen), c), config).collect()}
    assert (got[1].draft, got[1].answer, got[1].two_stage, got[1].fast_model, got[1].final_model) == ("the cat?", "the cat", True, "f", "m")
    assert got[2].answer is None and got[2].draft is None and got[2].error.startswith("ZeroDivisionError")
    [one] = prompts.corrected(pages.where("page_id = 1"), lambda c: prompts.caller(echo(seen), c), {}).collect()
    assert (one.draft, one.answer, one.two_stage, one.fast_model, one.final_model) == (None, "the cat?", False, None, prompts.DEFAULTS["model"])
    assert prompts.caller(echo([]), {"use_chat": False, "max_tokens": 9, "model": "g"})()("x") == "generated g 9"
    assert prompts.settings({"a": 1}, template={"a": 0, "b": 2}, stage={"c": 3}) == {"a": 1, "b": 2, "c": 3}


def test_workbook_prompts_against_plain_version(spark):
    data = "/root/testdata/sf0.001"
    of = catalog._pages(spark, data).where("page_id % 50 = 0").cache()
    b = catalog.boxes(spark, data)
    got = prompts.messages(documents.payload(of, b.where("label like 'marker%'")).withColumn("text", F.lit(None).cast("string")), {"prompt_mode": "workbook_json"}).collect()
    assert len(got) > 20
    for r in got:
        system, user = r.messages
        assert system.role == "system" and system.content == prompts.WORKBOOK_SYSTEM
        payload, own = json.loads(r.payload), json.loads(r.hints)
        lines = ["Convert the following OCR result into JSON.", "", "### Target JSON Schema (strict)", prompts.WORKBOOK_SCHEMA, "", "### Classification rules", *(f"- {x}" for x in prompts.CLASSIFICATION), "", "### How to extract", *(f"- {x}" for x in prompts.EXTRACTION), ""]
        if r.expected_numbers:
            lines += ["### Mandatory coverage", f"- You MUST include every question number in items.no: [{', '.join(map(str, r.expected_numbers))}]", '- If a question is unclear, still include it with type="other" and a short notes field.', ""]
        lines += ["### OCR cleanup hints (apply conservatively)", *(f"- {x}" for x in prompts.HINT_RULES), json.dumps(own, ensure_ascii=False, indent=2), "", "### Input (ordered OCR blocks)", json.dumps(payload, ensure_ascii=False, indent=2), ""]
        assert user.content == "\n".join(lines)
        assert list(payload) == ["page_no", "source", "blocks", "question_chunks", "expected_question_nos", "detected_question_nos_from_blocks"]
        assert all(set(x) == {"id", "kind", "role", "text", "bbox", "conf"} | (set() if x["kind"] == "mark" else {"question_no", "question_nos"}) for x in payload["blocks"])
        assert payload["expected_question_nos"] == r.expected_numbers == sorted({q["question_no"] for q in payload["question_chunks"]})
    [plain] = prompts.messages(spark.createDataFrame([("one\n\ntwo", None, None, None)], "text string, payload string, hints string, expected_numbers array<int>"), {"prompt_mode": "workbook_json"}).collect()
    shown = json.loads(plain.messages[1].content.split("### Input (ordered OCR blocks)\n")[1])
    assert shown == {"page_no": None, "blocks": [{"id": f"b00{i}", "kind": "printed", "role": "misc", "text": t, "bbox": None, "conf": None} for i, t in ((1, "one"), (2, "two"))]}
    assert "cleanup hints" not in plain.messages[1].content and "Mandatory coverage" not in plain.messages[1].content


def test_marked_images_are_dealt_out(spark):
    """Drawn as pixel by pixel, on all tasks though the keys are one small file."""
    drawn = catalog._marked(spark, "/root/testdata/sf0.001")
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for r in drawn.where("page_id < 72").collect():
        p, want = r.page_id, np.full((24, 60, 3), 0xF0, np.uint8)
        for j in range(3):
            left, top = 2 + 20 * j, 2 + (p + j) % 4
            want[top : top + 7 + (p * (j + 1)) % 8, left : left + 4 + (p * (j + 3)) % 9] = 0x20
        assert r.content == images.write_ppm(want)
