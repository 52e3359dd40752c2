"""Rules that SQL can't express, against examples and plain versions."""

import json
import random
import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import documents, geometry, prompts, questions, ranking
from pagemill.plans import catalog
from pagemill.sources import files
from pagemill.streaming import traces


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_question_numbers(spark):
    for text, want in (("12, first 3. b", [12, 3]), ("1.2.3.", [3]), ("1234. no", []), ("2.(a) 2.[b] 7.가", [2, 7]), ("", []), (None, []), ("5.", [5])):
        assert one(spark, text, T.question_numbers) == want


def test_question_pieces_drop_what_comes_first(spark):
    got = one(spark, "intro 1. a b 2. c", T.question_pieces)
    assert [(p.number, p.text) for p in got] == [(1, "1. a b"), (2, "2. c")]
    assert one(spark, "no number", T.question_pieces) == []


def test_option_candidates(spark):
    for text, want in (("[a } x", []), ("[one, two}", ["one", "two"]), ("{Red or BLUE}", ["Red", "BLUE"]), ("[a|A|b]", ["a", "b"]), ("(12)", []), ("[x / y] (p, q, X)", ["x", "y", "p", "q"]), ("['go' · “went”]", ["go", "went"]), ("(word)", [])):
        assert one(spark, text, T.option_candidates) == want


def test_text_measures(spark):
    assert one(spark, "가나다 abc", T.language_hint) == "mixed"
    assert one(spark, "가나다라마 a", T.language_hint) == "kor"
    assert one(spark, "빈칸에 쓰시오", T.role) == "instruction"
    assert one(spark, "a{b} a{b} ok 가b plain x_y", T.noisy_tokens) == ["a{b}", "가b"]
    assert one(spark, "  a \t b \n", T.compact) == "a b"
    q = spark.createDataFrame([("|{}@#$% x ~^ |||||", 0.4), ("", None)], "t string, c double").transform(lambda df: T.with_quality(df, F.col("t"), F.col("c"))).select(F.col("suspect_reasons").alias("r")).collect()
    assert q[0].r == ["low_quality_score", "high_symbol_ratio", "low_confidence"] and q[1].r == []


def test_nearest_question_gets_options(spark):
    rows = [(1, 1, 0.9, "1. go", 0.0, 0.0, 100.0, 20.0), (1, 2, 0.8, "[a, b]", 0.0, 30.0, 100.0, 50.0), (1, 3, 0.9, "2. on", 0.0, 300.0, 100.0, 320.0), (1, 4, 0.7, "[c, d]", 0.0, 2000.0, 100.0, 2020.0)]
    b = spark.createDataFrame(rows, "page_id long, pos int, conf double, txt string, x1 double, y1 double, x2 double, y2 double")
    got = {r.question_no: (r.option_candidates, r.context_text) for r in questions.chunks(b).collect()}
    assert got == {1: (["a", "b"], "1. go\n[a, b]"), 2: ([], "2. on")}


def test_boxes(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 5.0), (1, 3, 20.0, 0.0, 30.0, 10.0)]
    b = spark.createDataFrame(rows, "page_id long, det_seq int, x1 double, y1 double, x2 double, y2 double")
    assert {r.det_seq for r in geometry.suppress(b, 0.5).collect()} == {1, 2, 3}  # just at the threshold: kept
    assert {r.det_seq for r in geometry.suppress(b, 0.49).collect()} == {1, 3}
    m = spark.createDataFrame([(1, 9, 10.0, 0.0, 12.0, 2.0, "marker")], "page_id long, det_seq int, x1 double, y1 double, x2 double, y2 double, label string")
    assert geometry.intersecting(b, m).count() == 0  # edges touch
    assert geometry.suppress(b.limit(0)).count() == 0 and geometry.lines(b.limit(0)).count() == 0


def test_consensus_against_plain_version(spark):
    texts = ["The cat", "the  cat", "a cat", "", None]
    df = spark.createDataFrame([(1, 1, i, t, 0.5) for i, t in enumerate(texts)], "page_id int, box_id int, cand_seq int, text string, conf double")
    flat = [re.sub(r"\s+", " ", (t or "").strip().lower()) for t in texts]
    want = [sum(SequenceMatcher(None, a, b).ratio() for j, b in enumerate(flat) if j != i and a and b) for i, a in enumerate(flat)]
    got = {r.cand_seq: r.consensus for r in ranking.consensus(df).collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    assert [r.cand_seq for r in ranking.rank(ranking.consensus(df)).orderBy("rank").limit(2).collect()] == [1, 0] or got[0] == got[1]


def plain_score(text):
    t = text or ""
    return sum(c.isalnum() for c in t) + 0.3 * sum(c.isspace() for c in t) - 0.5 * sum(c in "@#$%^&*<>" for c in t) + 0.01 * len(t)


def test_picked_results_against_plain_version(spark):
    """Ties go to the earliest; copies of a text don't speak for it; null and empty texts count as nothing."""
    r = random.Random(7)
    texts = ["The cat sat", "the cat sat", "The cat  sat", "a c@t #at", "", None, "dog"]
    rows = [(page, 1, seq, r.choice(texts), r.choice([None, 0.1, 0.9])) for page in range(25) for seq in range(r.randint(1, 5))]
    df = spark.createDataFrame(rows, "page_id int, box_id int, cand_seq int, text string, conf double")
    for confidence in (True, False):
        got = {x.page_id: (x.cand_seq, x.total) for x in ranking.pick_result(df, confidence).collect()}
        assert len(got) == 25
        for page in range(25):
            own = [x for x in rows if x[0] == page]
            totals = []
            for _, _, seq, text, conf in own:
                a = text or ""
                agree = sum(SequenceMatcher(None, a, b[3] or "").ratio() for b in own if (b[3] or "") != a) if a else 0.0
                totals.append((plain_score(a) + agree + (conf or 0.0 if confidence else 0.0), seq))
            best = max(t for t, _ in totals)
            assert abs(got[page][1] - best) < 1e-9
            assert got[page][0] == min(seq for t, seq in totals if abs(t - best) < 1e-12) or sum(abs(t - best) < 1e-9 for t, _ in totals) > 1


def test_guarded_candidates_against_plain_version(spark):
    texts = ["the old river bank", "the  old river\nbank", "theoldriverbank", "zzz", "", None, "The old river banks of seven wise men, all of them long"]
    rows = [(i, a, b, ca, cb) for i, (a, b, ca, cb) in enumerate((a, b, ca, cb) for a in texts for b in texts for ca in (0.2, 0.6) for cb in (0.2, 0.5))]
    out = ranking.consistent(spark.createDataFrame(rows, "i int, text string, original_text string, conf double, original_conf double"), 0.5, 0.3, 20.0).collect()
    assert len(out) == len(rows)
    for x in out:
        bare = [re.sub(r"\s+", "", t or "") for t in (x.text, x.original_text)]
        like = SequenceMatcher(None, *bare).ratio() if all(bare) else 1.0
        reverted = like < 0.5 and x.conf - x.original_conf < 0.3 and plain_score(x.text) - plain_score(x.original_text) < 20.0
        assert abs(x.similarity - like) < 1e-12 and x.reverted == reverted


def test_detector_options():
    assert files.detector_options({}) == {"model": "yolov8n.pt", "conf": 0.25, "imgsz": 1024, "device": None, "classes": None, "max_det": 300, "crop_padding": 6, "line_thresh": 0.5}
    asked = files.detector_options({"conf": "0.5", "imgsz": 640.0, "device": "cuda:0", "classes": [1], "other": 1})
    assert (asked["conf"], asked["imgsz"], asked["device"], asked["classes"]) == (0.5, 640, "cpu", [1]) and "other" not in asked
    assert files.detector_options({"device": 0}, lambda: True)["device"] == 0
    assert [files.detector_options({"device": d})["device"] for d in ("cpu", "MPS", "")] == ["cpu", "MPS", ""]


def test_settings_of_a_template(tmp_path):
    (tmp_path / "t.yaml").write_text("domain: books\nstyle: long\n", encoding="utf-8")
    asked = {"prompt_template": str(tmp_path / "t.yaml"), "style": "short"}
    assert prompts.with_template(asked) == {**asked, "domain": "books"}
    assert prompts.with_template(None) == {} and prompts.with_template({"a": 1}) == {"a": 1}


def test_best_of_all_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PREPARED", 3)
    r = random.Random(3)
    words = "the quick brown fox jumps over a lazy dog near old river banks while seven wise men watch".split()
    known = [(i, " ".join(r.choice(words) for _ in range(r.randint(12, 50)))) for i in range(10)] + [(20, None), (21, ""), (22, "abc")]
    known.append((30, known[4][1]))  # a tie
    texts = [None, "", "abc", "zzz", "cba" * 300, *(t for _, t in known[:10])]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(20)]
    texts += [f"{'x' * 60} {t} and more" for _, t in known[:10]]  # alike beyond the first characters only
    rows = list(enumerate(texts))
    got = {x.conv_id: (x.match, x.ratio) for x in ranking.best_of_all(spark.createDataFrame(rows, "conv_id long, text string"), spark.createDataFrame(known, "seq long, text string"), 0.45).collect()}
    for i, t in rows:
        scored = [(SequenceMatcher(None, t, k).ratio(), -s, k) for s, k in known if k is not None] if t is not None else []
        ratio, _, match = max(scored, default=(0.0, 0, None))
        assert got[i] == ((match, round(ratio, 4)) if ratio >= 0.45 else (None, None))
    assert len(got) == len(rows)


def test_comparisons_are_difflibs():
    """Matches and ratios of texts with and without popular characters; bounds hold, and leave few pairs to compare."""
    r = random.Random(5)
    words = "The quick, brown fox jumps over a lazy dog near old river banks; while Seven wise men watch.".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 90))) for _ in range(30)] + ["", "a", "aaaa", "ab" * 120, "x" + "ab" * 120, "".join(chr(200 + i) for i in range(250))]
    for b in texts:
        known = ranking.Known(b)
        for a in texts:
            m = SequenceMatcher(None, a, b)
            assert ranking.ratio_from(a, known, 0.0, ranking.grams_of(a)) == m.ratio()
            for _ in range(4):
                lo, hi, b_lo, b_hi = *sorted(r.randint(0, len(a)) for _ in range(2)), *sorted(r.randint(0, len(b)) for _ in range(2))
                assert known.longest(a, lo, hi, b_lo, b_hi, known.starts(ranking.grams_of(a))) == tuple(m.find_longest_match(lo, hi, b_lo, b_hi))
    block = ranking.Block(texts)
    for a in texts:
        assert all(x >= SequenceMatcher(None, a, b).ratio() for x, b in zip(block.bounds(a, 0.3, ranking.grams_of(a)).tolist(), texts, strict=True))
    lines = ["".join(r.choice("etaoinshr ") for _ in range(150)) for _ in range(40)]
    longer = ["".join(r.choice("etaoinshr ") for _ in range(300)) for _ in range(5)]
    left = sum((ranking.Block(lines).bounds(a, 0.6, ranking.grams_of(a)) >= 0.6).sum() for a in longer)
    assert left <= 20  # of 200, which all have enough characters in common


def test_pieces_bound_ratios_of_texts_with_popular_characters():
    r = random.Random(6)

    def sentence():
        return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(8)).capitalize() + ". "

    texts = ["".join(sentence() for _ in range(r.randint(6, 8))) for _ in range(30)]
    others = ["".join(sentence() for _ in range(r.randint(1, 9))) for _ in range(10)] + [t[x : x + 180] for x, t in enumerate(texts[:10])] + ["", "e", texts[0]]
    block, left = ranking.Block(texts), 0
    assert not any(k.whole for k in block.known)
    for a in others:
        ratios = np.array([SequenceMatcher(None, a, b).ratio() for b in texts])
        bounds = block.bounds(a, 0.0, ranking.grams_of(a))
        assert (bounds >= ratios).all()
        left += int((bounds >= 0.45).sum()) - int((ratios >= 0.45).sum())
    assert left <= 0.2 * len(others) * len(texts)  # nearly all pairs have enough characters in common


def test_matched_lines_compares_whole_texts(spark, tmp_path):
    passage = "seven wise men watch the old river banks while a quick brown fox jumps over the lazy dog"
    spark.createDataFrame([(1, 0, "user", "So, before anything else, I would like to say this: " + passage)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(2, "nothing of it"), (4, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.match for r in catalog.QUERIES["matched_lines"](spark, str(tmp_path)).collect()] == [passage]


def test_documents():
    q = [{"question_no": 1, "text": "1. He went home", "block_ids": ["b001"], "confidence_min": 0.9, "options": ["went", "goes"], "context_text": "1. He went home [went, goes]"}, {"question_no": 3, "text": "3. x", "block_ids": ["b002"], "confidence_min": None, "options": [], "context_text": ""}]
    done = json.loads(documents.repaired_document(json.dumps({"items": [{"no": "z"}, {"no": 1, "prompt_en": "else", "options": []}]}), q))
    assert [x.get("no") for x in done["items"]] == [1, 3, "z"]
    first = done["items"][0]
    assert first["prompt_en"] == "1. He went home" and first["student_answer"] == "went" and first["evidence"]["block_ids"] == ["b001"]
    assert done["items"][1]["notes"] == documents.ADDED
    assert documents.repaired_document("{broken", q) == "{broken"
    assert json.loads(documents.fallback_document(q))["items"][0]["student_answer"] == "went"
    assert documents.answer_of(["apple", "pear"], "[apple, pear]") is None
    # brackets go first, and take the parenthesis that would have opened with them
    assert documents.answer_of(["go"], "(a [b) go]") is None and documents.answer_of(["go"], "(a b) go") == "go"
    assert documents.polygons([[[0, 0], [1, 0], [1, 1], [0, 1]], {"a": 1}, [["x"], [[[2, 2], [3, 2], [3, 3], [2, 3]]]]]) == [[(0, 0), (1, 0), (1, 1), (0, 1)], [(2, 2), (3, 2), (3, 3), (2, 3)]]


def test_failures_are_rows(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, prompt string")

    def client():
        def call(p):
            if p == "b":
                raise ValueError("no")
            return p.upper()

        return call

    got = {r.page_id: (r.answer, r.error) for r in documents.ask(prompts, client).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no")}


def test_trace_files(spark, tmp_path):
    e = spark.createDataFrame([("a/b", "2026-01-01T00:00:00Z", None, "{}", {"image": "x.png"})], files.TRACE)
    files.write_trace(e, str(tmp_path / "t"))
    assert files.read_trace(spark, str(tmp_path / "t")).collect() == e.collect()


def test_line_blocks_of_long_documents(spark, tmp_path):
    lines = [f"line {i}" for i in range(1, 1206)]
    spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.id, r.text) for r in catalog.QUERIES["line_blocks"](spark, str(tmp_path)).collect()]
    assert got == [(f"b{i:03d}", x) for i, x in enumerate(lines, 1)]


def test_ids_of_a_page_of_many_blocks(spark):
    """b999 is followed by b1000, in questions, in what they leave and in diagnoses."""
    rows = [(1, i, 0.9, f"1. part {i}" if i % 2 else f"said {i}", 0.0, 30.0 * i, 100.0, 30.0 * i + 20) for i in range(1, 1002)]
    b = spark.createDataFrame(rows, "page_id long, pos int, conf double, txt string, x1 double, y1 double, x2 double, y2 double")
    [q] = questions.chunks(b).collect()
    assert q.block_ids == [f"b{i:03d}" for i in range(1, 1002, 2)] and q.block_ids[-1] == "b1001"
    [page] = questions.compose(questions.pages(b)).collect()
    assert page.uncaptured_block_ids == [f"b{i:03d}" for i in range(2, 1002, 2)] and page.uncaptured_block_ids[-1] == "b1000"
    assert [r.block_id for r in questions.diagnose(b).orderBy("pos").collect()] == [f"b{i:03d}" for i in range(1, 1002)]


def test_token_ngrams_against_plain_version(spark, tmp_path):
    texts = ["", "one", "a b", "the quick brown fox jumps over a lazy dog", " ".join(f"w{i}" for i in range(400))]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_chars, r.grams) for r in catalog.QUERIES["token_ngrams"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = t.split(" ")
        assert got[i] == (len(t), " ".join("".join(w[a : a + k]) for a in range(len(w)) for k in (1, 2, 3) if a + k <= len(w)))


def plain_score(text):
    t = text or ""
    return sum(c.isalnum() for c in t) + 0.3 * sum(c.isspace() for c in t) - 0.5 * sum(c in "@#$%^&*<>" for c in t) + 0.01 * len(t)


def test_ensembles_against_plain_version(spark):
    r = random.Random(17)
    rows = []
    for region in range(60):
        for seq in range(r.randint(1, 5)):
            failed = r.random() < 0.3
            text = None if failed else "".join(r.choice("ab c#1") for _ in range(r.randint(0, 12)))
            rows.append((region, 1, seq, f"e{seq}", text, None if failed else r.randint(0, 100) / 100, float(seq + 1), "timeout" if failed else None))
    df = spark.createDataFrame(rows, "page_id long, box_id int, cand_seq int, engine string, text string, conf double, latency_ms double, error string")
    got = {x.page_id: x for x in ranking.ensemble(df).collect()}
    for region in range(60):
        own = [x for x in rows if x[0] == region]
        there = [x for x in own if x[7] is None]
        total = [plain_score(x[4]) + sum(SequenceMatcher(None, x[4], y[4]).ratio() for y in there if y[4] != x[4] and x[4]) + x[5] for x in there]
        g = got[region]
        assert [e.engine for e in g.errors] == [x[3] for x in own if x[7]] and [c.engine for c in g.candidates] == [x[3] for x in there]
        assert g.engine == "ensemble" and g.latency_ms == sum(x[6] for x in own)
        if there:
            best = max(range(len(there)), key=lambda i: (round(total[i], 9), -i))
            assert (g.text, g.conf, g.selected) == (there[best][4], there[best][5], there[best][3])
        else:
            assert (g.text, g.conf, g.selected) == ("", 0.0, None)


def test_engines_that_are_missing():
    def make(name):
        if name == "gone":
            raise ImportError("no such engine")
        return name.upper()

    assert ranking.available(["a", "gone"], make, allow_missing=True) == ({"a": "A"}, ["gone: no such engine"])
    for least, allow in ((1, False), (2, True)):
        try:
            ranking.available(["a", "gone"], make, allow_missing=allow, least=least)
        except (ImportError, RuntimeError):
            continue
        raise AssertionError


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = [max(1e-6, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    return w * h / (size[0] + size[1] - w * h)


def plain_suppressed(found, threshold, most):
    kept = []
    for _, b in sorted(found, key=lambda x: (-(x[1][2] - x[1][0]) * (x[1][3] - x[1][1]), x[0])):
        if all(plain_iou(k, b) <= threshold for k in kept):
            kept.append(b)
    return kept[:most]


def test_detector_chain_against_plain_version(spark):
    r = random.Random(23)
    rows = [(p, s, [(float(r.randint(-20, 120)), float(r.randint(-20, 90))) for _ in range(4)]) for p in range(12) for s in range(1, 15)]
    found = spark.createDataFrame([(p, s, [{"x": x, "y": y} for x, y in poly]) for p, s, poly in rows], "page_id long, det_seq int, polygon array<struct<x:double,y:double>>")
    size = spark.createDataFrame([(p, 100, 70) for p in range(12)], "page_id long, width int, height int")
    odd, even = found.where("det_seq % 2 = 1"), found.where("det_seq % 2 = 0")
    out = geometry.plugin_boxes({"odd": odd, "even": even, "off": found}, ["even", "odd"], size, min_area=200.0, most=4).collect()
    got = {p: [(x.plugin, x.x1, x.y1, x.x2, x.y2) for x in sorted((x for x in out if x.page_id == p), key=lambda x: x.det_seq)] for p in range(12)}
    sources = {}
    for p in range(12):
        want = []
        for name, rest in (("even", 0), ("odd", 1)):
            on = []
            for q, s, poly in rows:
                if q == p and s % 2 == rest:
                    x1, y1, x2, y2 = min(x for x, _ in poly), min(y for _, y in poly), max(x for x, _ in poly), max(y for _, y in poly)
                    if (x2 - x1) * (y2 - y1) >= 200:
                        b = (max(0.0, min(100.0, x1)), max(0.0, min(70.0, y1)), max(0.0, min(100.0, x2)), max(0.0, min(70.0, y2)))
                        if b[2] > b[0] and b[3] > b[1]:
                            on.append((s, b))
            sources[p, name] = plain_suppressed(on, 0.4, 4)
            want += [(name, *b) for b in sources[p, name]]
        assert got[p] == want
    groups = [spark.createDataFrame([(p, i, *b) for p in range(12) for i, b in enumerate(sources[p, name])], "page_id long, det_seq int, x1 double, y1 double, x2 double, y2 double") for name in ("even", "odd")]
    merged = geometry.merged(groups, 0.5, 5).collect()
    for p in range(12):
        every = list(enumerate(sources[p, "even"] + sources[p, "odd"]))
        assert [tuple(getattr(x, c) for c in geometry.BOX) for x in sorted((x for x in merged if x.page_id == p), key=lambda x: x["rank"])] == plain_suppressed(every, 0.5, 5)
    assert geometry.plugin_boxes({}, [], size).count() == 0


def test_fallback_boxes(spark):
    size = spark.createDataFrame([(1, 100, 60)], "page_id long, width int, height int")
    assert [tuple(r) for r in geometry.fallback_grid(size, mode="full").collect()] == [(1, 1, 8.0, 8.0, 92.0, 52.0)]
    assert geometry.fallback_grid(size, enabled=False).count() == 0 and geometry.fallback_grid(size, 0, 1).count() == 1


def test_documents_are_written_and_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "said", "", [{"idx": 1}], {"[FORMULA_1]": [0.0, 1.0, 2.0, 3.0]}), (2, "", "{}", [], None)], "page_id long, raw_text string, corrected string, options array<map<string,int>>, formula_map map<string,array<double>>")
    final = documents.assembled(pages)
    first = json.loads(final.where("page_id = 1").first().document)
    assert list(first) == list(documents.PARTS) and first["formula_map"] == {"[FORMULA_1]": [0, 1, 2, 3]} and first["llama"] is None
    documents.write_documents(final, str(tmp_path / "d"))
    got = documents.evaluate(documents.read_documents(spark, str(tmp_path / "d")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, True, False, 1, 1, 0), (2, False, True, 0, 0, 0)]
    (tmp_path / "one.json").write_text(json.dumps(first, indent=2), encoding="utf-8")
    [whole] = documents.evaluate(documents.read_documents(spark, str(tmp_path / "one.json"), whole_files=True)).collect()
    assert tuple(whole)[1:] == (True, False, 1, 1, 0)
    documents.write_report(got, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    try:
        documents.read_documents(spark, str(tmp_path / "missing")).count()
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)
    else:
        raise AssertionError


def test_sources(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a/b.png\n\n c.png \n")
    assert [r.path for r in files.listed_paths(spark, str(tmp_path / "train.txt")).collect()] == ["a/b.png", "c.png"]
    assert [one(spark, p, T.base_name) for p in ("/a/b.png", "b.png", "a/b/", "", None)] == ["b.png", "b.png", "b", "", None]
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x, 가]\n", encoding="utf-8")
    assert prompts.read_config(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x", "가"]}
    for name in ("good", "bad"):
        (tmp_path / "scans").mkdir(exist_ok=True)
        (tmp_path / "scans" / f"{name}.bin").write_bytes(name.encode())

    def engine():
        def find(content):
            if content == b"bad":
                raise ValueError("unreadable")
            return [{"text": "x"}, {"text": "y"}]

        return find

    out = files.recognise(files.pages(spark, str(tmp_path / "scans")), engine, "text string").collect()
    assert sorted((r.text or "", bool(r.errors)) for r in out) == [("", True), ("x", False), ("y", False)] and all(r.latency_ms >= 0 for r in out)
    page = spark.createDataFrame([(1, list(range(500)), list(range(500)))], "page_id long, boxes array<int>, chars array<int>")
    [t] = files.traced(page).collect()
    assert (len(t.boxes), len(t.chars)) == (200, 400)


def test_artifacts(spark, tmp_path):
    e = spark.createDataFrame([(1, "ocr/raw", "said", None, None), (1_000_000, "x y", None, "{}", b"png")], "log_seq long, stage_name string, text string, json string, image binary")
    named = files.with_artifacts(e, "run/")
    assert [dict(r.artifacts) for r in named.orderBy("log_seq").collect()] == [{"text": "run/000001_ocr_raw.txt"}, {"json": "run/1000000_x_y.json", "image": "run/1000000_x_y.png"}]
    files.write_artifacts(named, str(tmp_path / "a"))
    assert {r.name: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "a")).collect()}["run/1000000_x_y.png"] == b"png"


def test_streams_of_traces(spark, tmp_path):
    rows = [("a", "2026-01-01T00:00:00Z", 5.0), ("a", "2026-01-01T00:00:30Z", 7.0), ("b", "2026-01-01T00:05:00Z", None), ("", "2026-01-01T00:06:00Z", 1.0), ("a", "2026-01-01T01:00:00Z", 9.0)]
    for i, (stage, at, took) in enumerate(rows):
        files.write_trace(spark.createDataFrame([(stage, at, took, "{}", None)], files.TRACE), str(tmp_path / f"t{i}"))
    stream = traces.events(spark, str(tmp_path / "t*"), files_a_batch=100)
    for name, df, mode in (("latest", traces.latest_by_stage(stream), "complete"), ("latency", traces.latency(stream), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r.stage_name, r.latency_ms, r.events) for r in spark.table("latest").collect()} == {("a", 9.0, 3), ("b", None, 1)}
    got = {(r.stage_name, r.start.minute, r.events, r.mean_ms) for r in spark.table("latency").collect()}
    assert ("a", 0, 2, 6.0) in got and all(r[0] != "a" or r[2] == 2 for r in got)  # the last window is still open
