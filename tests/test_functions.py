import pytest
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators import assemble, boundary, decision, furniture, layout, metrics, model
from pagestream.plans.pipeline import PipelineConfig, evaluate, parse


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize("text,want", [("Page 3 of 9", (3, 9)), ("3/9", (3, 9)), ("p. 3 of 9", (3, 9)), ("\n\n 2 of 4 \nrest", (2, 4)), ("ratio 1/2 here", None), ("", None), ("Page 3", None)])
def test_page_fraction(spark, text, want):
    got = one(spark, text, T.page_fraction)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize("text,want", [("Total due Page 1 of 2", ("Total due", "Page 1 of 2")), ("a p. 1/2", ("a", "p. 1/2")), ("Page 1 of 2", None), ("sum 1 of 2", None), ("x page 1 of 2 page 3 of 4", ("x page 1 of 2", "page 3 of 4"))])
def test_trailing_label(spark, text, want):
    got = one(spark, text, T.trailing_label)
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize("text,want", [("  ", "scan"), ("short", "mixed"), ("x" * 40, "text"), (None, "scan")])
def test_page_class(spark, text, want):
    assert one(spark, text, T.page_class).page_class == want


@pytest.mark.parametrize("text,kind,level", [("1.2 Scope", "heading", 2), ("Chapter IV", "heading", 1), ("GENERAL TERMS", "heading", 1), ("- point", "list_item", None), ("3) point", "list_item", None), ("Just words.", "paragraph", None), ("1.2.3.4.5.6.7.8 deep", "heading", 6)])
def test_block_kind(spark, text, kind, level):
    got = one(spark, text, lambda c: T.block_kind(c, F.lit(False)))
    assert (got.kind, got.heading_level) == (kind, level)


ENGLISH = "The tenant shall pay the rent to the landlord on the first day of the month and it is due in full for the term of this lease."
GERMAN = "Der Mieter zahlt die Miete an den Vermieter und das ist nicht von der Sache mit sich des Hauses auf dem Land für ein Jahr."


@pytest.mark.parametrize("text,want", [(ENGLISH, "en"), (GERMAN, "de"), ("short", None), ("日本語の文章がここにありますので、これは日本語です。もう少し長い文章にします。", "ja"), ("Это предложение написано на русском языке довольно длинное", "cyrillic")])
def test_detect_language(spark, text, want):
    assert one(spark, text, T.detect_language) == want


@pytest.mark.parametrize("text,want", [("XIV", 14), ("IV", 4), ("CMXCIX", 999), ("IIII", None), ("", None)])
def test_roman(spark, text, want):
    assert one(spark, text, T.roman) == want


@pytest.mark.parametrize("text,want", [("The probability is 0.7", 0.7), ("about 70 percent", None), ("-0.2", None), ("score 1", 1.0), ("page 1", None), ("0.2 or 0.3", None), ("it is 1.7", None)])
def test_sentence_probability(spark, text, want):
    assert one(spark, text, T.sentence_probability) == want


def test_reply_ladder_and_secrets(spark):
    assert one(spark, '{"probability": 0.25}', decision.reply_probability) == 0.25
    assert one(spark, "NaN", decision.reply_probability) is None
    with pytest.raises(ValueError):
        decision.reject_secrets({"a": [{"API_KEY": "x"}]})


def test_furniture_both_ways(spark):
    pages = [("b", k, f"Binder Header\nbody {k}\nACME Corp confidential 2026-0{k}\nPage {k + 1} of 2") for k in range(2)]
    df = spark.createDataFrame(pages, "bundle_id string, page_index int, text string")
    final = {x.page_index: x for x in furniture.tags(df).collect()}
    stream = {x.page_index: x for x in furniture.tags(df, final=False).collect()}
    assert all(final[k].is_header and final[k].is_footer and final[k].is_page_number for k in range(2))
    assert not stream[0].is_header and stream[1].is_header


def test_shared_header_signal(spark):
    rows = [("s", 0, 1, 2), ("s", 1, 2, 2), ("s", 2, 1, 2), ("s", 3, 2, 2)]
    df = spark.createDataFrame(rows, "bundle_id string, page_index int, page_num int, page_total int").withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "rotation": F.lit(0)})
    got = {x.page_index: x for x in boundary.combine(boundary.number_signals(df)).collect()}
    assert got[2].confidence == pytest.approx(0.65) and got[2].reason == "page_number_reset+sequence_completed"
    assert got[0].confidence is None and got[1].confidence is None


BUILTIN = {
    "text-layer": (["ACME Annual Report\n1. Overview\nBody of page one.\nPage 1 of 3", "Section continues.\nMore body text on page two.\nPage 2 of 3", "Closing remarks.\nPage 3 of 3"], [(0, 2)]),
    "multi-doc": (["Northwind Invoice\nAmount due: 12.00\nPage 1 of 2", "Thank you for your business.\nPage 2 of 2", "Contoso Lease\nPremises: 1 Main St\nPage 1 of 2", "Signatures follow.\nPage 2 of 2"], [(0, 1), (2, 3)]),
    "shared-header": (["Binder Header\nChapter A body.\nPage 1 of 2", "Binder Header\nChapter A continued.\nPage 2 of 2", "Binder Header\nChapter B body.\nPage 1 of 2", "Binder Header\nChapter B continued.\nPage 2 of 2"], [(0, 1), (2, 3)]),
    "unnumbered-cover": (["Fabrikam Service Agreement\nPrepared for Contoso", "1. Scope\nServices are described here.\nPage 2 of 3", "2. Term\nThe term is one year.\nPage 3 of 3"], [(0, 2)]),
    "scan": (["", ""], [(0, 1)]),
}


def test_builtin_bundles_are_parsed_whole(spark):
    """Lines stand as blocks of their own, as a text layer's lines do."""
    pages = [(name, k, t.replace("\n", "\n\n")) for name, (texts, _) in BUILTIN.items() for k, t in enumerate(texts)]
    df = spark.createDataFrame(pages, "bundle_id string, page_index int, text string")
    out = parse(df, PipelineConfig())
    ranges = {}
    for x in out.documents.collect():
        ranges.setdefault(x.bundle_id, []).append((x.page_start, x.page_end))
    assert {k: sorted(v) for k, v in ranges.items()} == {k: g for k, (_, g) in BUILTIN.items()}
    gold = spark.createDataFrame([(n, i, a, b) for n, (_, g) in BUILTIN.items() for i, (a, b) in enumerate(g)], "bundle_id string, doc_index int, page_start int, page_end int")
    scores, gate = evaluate(gold, out.documents, 1.0, 1.0)
    assert gate.head().passed and scores.count() == 5


def test_no_split_keeps_one_document(spark):
    pages = [("m", k, t.replace("\n", "\n\n")) for k, t in enumerate(BUILTIN["multi-doc"][0])]
    out = parse(spark.createDataFrame(pages, "bundle_id string, page_index int, text string"), PipelineConfig(split_on_boundary=False))
    assert out.documents.count() == 1 and out.decisions.where("split").count() == 1


def test_gate_rejects_nan_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1, 0, 0, float("nan"))], "bundle_id string, tp int, fp int, fn int, f1 double")
    assert not metrics.gate(rows, 0.0, 0.0).head().passed
    assert not metrics.gate(rows.limit(0), 0.0, 0.0).head().passed


def test_sections_nest_and_extend(spark):
    rows = [(0, 0, "paragraph", None, "before"), (0, 1, "heading", 1, "1 A"), (0, 2, "heading", 2, "1.1 B"), (1, 0, "paragraph", None, "x"), (2, 0, "heading", 2, "1.2 C"), (3, 0, "heading", 1, "2 D")]
    df = spark.createDataFrame([("p", *r, f"b{i}") for i, r in enumerate(rows)], "bundle_id string, page_index int, reading_order int, kind string, heading_level int, text string, block_id string")
    got = {x.section_id: (x.level, x.parent_ord, x.page_start, x.page_end) for x in assemble.sections(df).collect()}
    assert got == {"anon-1": (1, None, 0, 0), "b1-sec": (1, None, 0, 2), "b2-sec": (2, 2, 0, 1), "b4-sec": (2, 2, 2, 2), "b5-sec": (1, None, 3, 3)}


def test_grounding_tags(spark):
    raw = "![text](75,49,246,110) Northwind Invoice Amount due: 12.00 Page 1 of 2"
    df = spark.createDataFrame([("p", 0, raw, None, None)], "bundle_id string, page_index int, raw string, width double, height double")
    got = layout.grounding_blocks(df).orderBy("reading_order").collect()
    assert [(x.kind, x.text) for x in got] == [("paragraph", "Northwind Invoice Amount due: 12.00"), ("page_number", "Page 1 of 2")]


def test_weights_round_trip_and_validation(spark):
    w = model.Weights([0.0] * 16, [1.0] * 16, [0.0] * 16, 0.0)
    assert model.Weights.from_json(w.to_json()) == w
    for bad in (w.to_json().replace("1.0", "0.0", 1), "[]", w.to_json().replace("has_num", "other")):
        with pytest.raises(ValueError):
            model.Weights.from_json(bad)
    df = spark.createDataFrame([[1.0] * 16], list(model.FEATURES))
    assert df.select(model.probability(w).alias("p")).head().p == 0.5


def test_distributed_training_equals_the_driver(spark, monkeypatch):
    rows = [(float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    one = model.train(df, names=("a", "b"), epochs=3)
    monkeypatch.setattr(model, "DRIVER_ROWS", 5)
    two = model.train(df, names=("a", "b"), epochs=3)
    assert one.weights == pytest.approx(two.weights) and one.bias == pytest.approx(two.bias)
