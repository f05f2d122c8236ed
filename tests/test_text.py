from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import vault


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("word", ["Café", "ÀÉÎÕÜ çñ", "straße", "Ωmega", "ő Ǘ ễ", ""])
def test_fold_is_nfd_without_marks(spark, word):
    expected = "".join(c for c in unicodedata.normalize("NFD", word) if not 0x300 <= ord(c) <= 0x36F).lower()
    assert one(spark, T.fold(F.lit(word))) == expected


def test_strip_markdown(spark):
    raw = "---\ntitle: x\n---\n# Head\n> quote [link](http://a) `code` **bold**\n```\nfence\n```\nend_word"
    assert one(spark, T.strip_markdown(F.lit(raw))) == "Head quote link code bold endword"


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, T.tokens(F.lit("The box, the BOX and a Càffè x 42"))) == ["box", "box", "caffe", "42"]
    assert one(spark, T.tokens(F.lit(""))) == []


@pytest.mark.parametrize(
    ("text", "needle", "expected"),
    [("a lead time", "lead", True), ("leader", "lead", False), ("misleading", "lead", False), ("lead", "lead", True), ("x-lead.", "lead", True), ("lead9", "lead", False), ("anything", " ", False), ("a.b c", "a.b", True), ("azb", "a.b", False)],
)
def test_whole_words(spark, text, needle, expected):
    assert one(spark, T.contains_whole_words(F.lit(text), F.lit(needle))) is expected


def test_snippet_is_cut_around_the_first_term(spark):
    text = "x" * 200 + " needle " + "y" * 200
    s = one(spark, T.snippet(F.lit(text), ["needle"]))
    assert s.startswith("...") and s.endswith("...") and "needle" in s and len(s) == 186
    assert one(spark, T.snippet(F.lit("short"), ["needle"])) == "short"
    marked = "e\u0301" * 200 + " ne\u0301edle " + "y" * 300
    assert "ne\u0301edle" in one(spark, T.snippet(F.lit(marked), ["needle"]))


def test_codes_ids_and_embedding_text(spark):
    assert [one(spark, T.is_exact_code(F.lit(x))) for x in ("CL-101", "box", "a1", "a_b", "x y-1")] == [True, False, False, True, False]
    assert one(spark, T.normalize_id(F.lit("doc_" + "a" * 64))) == "doc_" + "a" * 16
    assert one(spark, T.embedding_text(F.lit("Guide"), F.lit("c"), F.lit("p"), F.lit("twelve chars"))) == "Gu\ntwelve chars"
    assert one(spark, T.embedding_text(F.lit(""), F.lit(" "), F.lit(""), F.lit("passage"))) == "passage"


def test_redaction_and_paths(spark):
    assert one(spark, T.redact(F.lit("key sk-abcdefghijkl1 and Bearer abc.def"))) == "key [REDACTED_API_KEY] and Bearer [REDACTED_TOKEN]"
    assert [one(spark, T.is_safe_path(F.lit(p))) for p in ("a/b.md", "a", "a/../b", "a//b", "a\\b/c", "./a")] == [True, False, False, False, False, False]


def test_decoding(spark):
    for raw, expected in ((b"\xef\xbb\xbfa\r\nb", "a\nb"), ("é".encode("utf-16"), "é"), (b"  ", None)):
        assert one(spark, vault.decode_text(F.lit(raw))) == expected


@pytest.mark.parametrize(
    ("text", "state"),
    [("plain", "READY"), ("---\ntitle: A\nstatus: draft\n---\nbody", "READY"), ("---\r\ntitle: A\r\n---\r\nx", "READY"), ("---\ntitle: A\nbody", "INVALID"), ("---\nstatus: odd\n---\nx", "INVALID"), ("---\nnot a mapping\n---\nx", "INVALID")],
)
def test_front_matter(spark, text, state):
    assert one(spark, vault.front_matter(F.lit(text)))["state"] == state


def test_html_text(spark):
    html = "<title>T</title><script>var a='<p>';</script><p>a &amp; b</p><!-- c --><style>x</style>d"
    assert one(spark, vault.html_text(F.lit(html))) == "T a &amp;amp; b d"
    assert one(spark, vault.html_text(F.lit('<p title="a>b">x</p><noscript><template>n</noscript></template></noscript>y<b unclosed'))) == "x y"
    assert one(spark, vault.html_title(F.lit(html))) == "T"


def test_tokens_of_texts_with_and_without_markdown(spark):
    texts = [
        "plain words here", "a*bc* de_fg", "# Head\n## Two\nbody", "> said\n>> so", "---\nkey: value\n---\nbody text", "x\n---\nkey: value\n---\n", "[link text](http://example.org/page)", "```\ncode here\n```\nafter", "`ab`cd",
        "À la règle", "été box", "ΟΔΟΣ # ΣΑΣ", "\r\n# A\u0085# BB > CC", "", "  ", None, "--- \nbox", "tab\tand  space", "#tag #2two", "1) [ ] done",
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    words = F.split(T.fold(T.strip_markdown(F.col("text"))), "[^\\p{L}\\p{N}]+")
    want = F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(T.STOP_WORDS))
    assert [r for r in rows.select(T.tokens(F.col("text")).alias("t"), want.alias("w")).collect() if r["t"] != r["w"]] == []
