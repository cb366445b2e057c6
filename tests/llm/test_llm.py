"""Encoding against the public libraries, packing against its rules, residue against planted texts."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("ahocorasick")
from tidemark.llm.packing import BestFit, pack_documents
from tidemark.llm.residue import candidate_messages, classified_messages, mask, plain_text, residue_documents
from tidemark.llm.tokenize import TOKENIZER_DIR, WORDS, Encoder, encode_corpus, frequent_words, lexicon_of, merge_word, pieces_of, read_ranks, token_counts, word_counts
from tidemark.llm.transducer import Lexicon, compile_lexicon

PATH = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
needs_files = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    words = [(t, (r,)) for t, r in ranks.items() if r % 2]  # half of the words are unseen
    return Encoder(Lexicon(compile_lexicon(words, ranks)), memo=50)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<i4").tolist()


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=80, deadline=None)
def test_transducer_is_the_dictionary(table, others):
    lexicon = Lexicon(compile_lexicon(table.items(), {b"x": 0}))
    asked = [*table, *others]
    for word, number in zip(asked, lexicon.numbers(asked).tolist() if asked else [], strict=True):
        assert (number >= 0) == (word in table)
        if number >= 0:
            assert lexicon.ids(number).tolist() == table[word]


def test_transducer_shares_suffixes():
    words = [a + b"ing" for a in (b"walk", b"talk", b"runn")]
    lexicon = Lexicon(compile_lexicon([(w, (i,)) for i, w in enumerate(words)], {b"x": 0}))
    assert len(lexicon.final) < sum(map(len, words)) - 6
    assert Lexicon(compile_lexicon([], {})).numbers([b"a", b""]).tolist() == [-1, -1]


AWKWARD = [
    "", " ", "  ", "\n", "a  b", " a", "a ", "don't we'll", "x\n\n y", " a　b", "​z", "é é", "😀 👩‍💻", "<|endoftext|>", "12345 6789", "中文，没有空格。", "\x1f\x1c a", "tab\t\tend\r\n", "a" * 5000, "é" * 3000,
    "!!! ...---", "ΑΒΓ ½ ﬁ", "word \n next", "   \n  x  ",
]


@needs_files
@pytest.mark.parametrize("text", AWKWARD)
def test_encoding_equals_the_public_library(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


@needs_files
@given(text=st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_equals_the_public_library(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder, text) == reference.encode_ordinary(text)
    a, b = pieces_of(text) if text else ([], [])
    assert "".join([*a, *[" " + p for p in b]]) == text


@needs_files
@given(word=st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merge_takes_the_lowest_rank_first(ranks, word):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None or word in ranks:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert merge_word(word, ranks) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])


DOCS = "doc_id bigint, text string, source string, ids int, n_tokens int"


@needs_files
def test_corpus_encoding_and_counts(spark, reference):
    texts = [*AWKWARD, None, "the same", "the same"]
    docs = spark.createDataFrame([(i, t, None, 1, 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in encode_corpus(docs).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {k: len(v) for k, v in got.items()}
    assert encode_corpus(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 100), max_size=300), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_best_fit_never_overfills(sizes, open_bins):
    packer, used = BestFit(100, open_bins), {}
    for size in sizes:
        bin_, position = packer.add(size)
        assert position == used.get(bin_, 0)
        used[bin_] = position + size
        assert used[bin_] <= 100 and packer.open <= open_bins
    for free, bins in packer.by_free.items():
        assert packer.bits >> free & 1 and all(100 - used[b] == free for b in bins)


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    packer = BestFit(10, 2)
    assert [packer.add(s)[0] for s in (6, 7, 3)] == [0, 1, 1]  # 3 fits exactly beside 7
    assert packer.add(8)[0] == 2 and packer.add(9)[0] == 3  # two are open, the fullest of three (9) closes
    assert packer.add(2)[0] == 2 and packer.add(4)[0] == 0


@needs_files
def test_packing_keeps_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    caps = spark.createDataFrame([(1, "tiny", 60), (2, "short", 512), (3, "bad", 0), (4, "none", None)], "pack_id bigint, pack_name string, capacity_tokens int")
    rows = pack_documents(docs, caps, docs_per_packer=40).toPandas()
    length = {r.doc_id: r.n_tokens for r in token_counts(docs).collect() if r.n_tokens}
    assert set(rows.pack_id) == {1, 2}
    for pack, capacity in ((1, 60), (2, 512)):
        mine = rows[rows.pack_id == pack]
        for doc, parts in mine.sort_values("part").groupby("doc_id"):
            assert parts.n_tokens.sum() == length[doc] and parts.token_offset.tolist() == np.r_[0, parts.n_tokens.cumsum()[:-1]].tolist()
            assert len(parts) == max(1, -(-length[doc] // capacity))
        assert set(mine.doc_id) == set(length)
        for _, box in mine.sort_values("position").groupby("container_id"):
            assert box.position.tolist() == np.r_[0, box.n_tokens.cumsum()[:-1]].tolist() and box.n_tokens.sum() <= capacity
        fill = mine.n_tokens.sum() / (mine.container_id.nunique() * capacity)
        assert fill > 0.75
    key = ["container_id", "position"]
    again = pack_documents(docs.repartition(7), caps, docs_per_packer=40).toPandas()
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))  # however the input is cut
    assert pack_documents(docs.limit(0), caps).count() == 0


BAD = [
    "Carry stood at {{ carry_pct | round(2) }} today.", "Close of ${session_date}", "Curve note: {ticker}", "It moved by {0:.2f}.", "Seen at %(time)s in the log", "On %SESSION_DATE% it fell", "@@TICKER@@ review", "<%= date %>",
    "Close of <report_date_here>", "Curve note: <your series_id>", "<<settle>> printed", "Daily weather, «report-date»", "[[tenor]] leg", "[INSERT DATE] was it", "Kept for [TBD].", "Was __CARRY_ANSWER__ today", "The XX.XX leg closed", "wants #### confirmations.",
    "截至 ××数值××，尚未到达", "于 〔请填写日期〕 保持", "共有 【数量】 条", "{% endfor %}", "Lorem ipsum dolor sit amet.", "Ullamco fugiat nostrud veniam labore.", "Your text goes here. Your text goes here.", "Replace before publishing.", "asdf asdf asdf asdf asdf asdf", "foo bar foo bar foo bar foo bar foo bar",
    "Heading 1 text\nCaption 2\nParagraph 3 …", "这里是示例文字，这里是示例文字，", "502 Bad Gateway", "HTTP/1.1  \t403 \tForbidden", "Error 404: Página no encontrada.", "<html><head><title>403 Forbidden</title></head></html>", '{"message":"Rate limit exceeded","code":429}', "Your session has expired. Please sign in again.",
    "Traceback (most recent call last):\n  File x", "您没有权限访问该页面", "Fehler 404 – Seite nicht gefunden.", "Please enable JavaScript to view this page.", "Kindly allow scripting, then refresh.", "For full access unblock cookies and JavaScript in your browser!", "YOUR TEXT GOES HERE.",
    "Your text goes​ here.", "Checking your browser before granting access.", "请启用 JavaScript 后刷新本页面。", "Esta aplicación necesita scripts y cookies habilitados.",
]
GOOD = [
    None, "", "  \n ", "The writer uses slots such as `{{session_date}}` and `${phase}`; it raises an error when one has no value.", "It looks like this:\n\n```\nPhase on ${session_date}\n%(score)s\n```\n\nRendered it read: calm.", "Set {F1 F2 F3} is called the front group; [F4 F5] is the middle.",
    "On 2020-01-01 they stood at <19.5> and <20.1> in the print-out.", "The front slope is $s = \\frac{\\ln(F_{2}/F_{1})}{d_{2}-d_{1}}$.", "Two of 40 downloads failed with 503 Service Unavailable on 2020-01-02.", "12:01 ERROR GET VIX_History.csv returned 404, falling back to last success",
    'Ticket 3: readers saw "Your session has expired" when opening the note.', "Since 2020-01-02 the dashboard draws its charts with JavaScript; readers who block scripts get the 20-row table instead.", "Access to the VIX archive was denied to the batch user.", '{"session_date": "2020-01-02", "phase": "CALM", "scores": {"carry": 1}, "errors": []}',
    "The last trading day is still to be determined by the exchange.", "The reviewer struck out the sample paragraph about VIX.", "Ceteris paribus, an ex ante probability says little.", "自 2020 起图表改用 JavaScript 绘制，关闭脚本的读者仍可查看表格。", "### Heading of a note\n\nBody of it.", "It rose 5% and then 7% more.",
]


def test_residue_and_its_look_alikes(spark):
    rows = [(i, t, "s", 0, 0) for i, t in enumerate(BAD)] + [(1000 + i, t, None, 0, 0) for i, t in enumerate(GOOD)]
    long = "Nothing to see. " * 6000
    rows += [(2000, long + "Close of {{date}}", "s", 0, 0), (2001, long, "s", 0, 0), (2002, BAD[0], "t", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id for r in residue_documents(docs).collect()}
    assert {t for i, t in enumerate(BAD) if i not in found} == set()
    assert {t for i, t in enumerate(GOOD) if 1000 + i in found} == set()
    assert {2000, 2002} <= found and 2001 not in found
    assert residue_documents(docs.limit(0)).count() == 0


def test_messages_are_grouped_across_sources(spark):
    rows = [(i, f"Access denied. Case {i}", f"s{i % 3}", 0, 0) for i in range(6)] + [(9, "403 Forbidden", "s", 0, 0)]
    got = {r.message: r for r in classified_messages(candidate_messages(spark.createDataFrame(rows, DOCS))).collect()}
    assert (got["access denied."].n_documents, got["access denied."].n_sources, got["access denied."].kind) == (6, 3, "error page")
    one = classified_messages(candidate_messages(spark.createDataFrame(rows[:1], DOCS))).first()
    assert one.kind is None  # not recurring


def test_masks():
    assert mask("seen 2020-01-02 at 10:15:00 on https://a.b/c by x@y.org, id 4190d363fea8") == "seen 0 at 0 on @ by @, id 0"
    assert plain_text("Ａ​B  c\r\n D") == "ab c\nd"


@needs_files
def test_lexicon_holds_the_frequent_words_of_all_rows_with_all_their_ids(spark, ranks):
    docs = spark.createDataFrame([(i, t, None, 1, 2) for i, t in enumerate(["quaxly floon, quaxly", "the quaxly  the", None, "", "once 12345 12345", "x" * 200 + " " + "x" * 200])], DOCS)
    counts = {r.word: r.n for r in word_counts(docs).collect()}
    assert counts == {"quaxly": 3, "floon,": 1, "the": 2, "once": 1, "12345": 2}
    assert frequent_words(docs) == ["quaxly", "12345", "the"] and frequent_words(docs, most=1) == ["quaxly"]
    lexicon = Lexicon(lexicon_of(frequent_words(docs), ranks))
    numbers = lexicon.numbers([b" quaxly", b" the", b" once", b" 12345"]).tolist()
    assert numbers[2] == -1 and min(numbers[0], numbers[1], numbers[3]) >= 0
    assert lexicon.ids(numbers[0]).tolist() == merge_word(b" quaxly", ranks) and len(lexicon.ids(numbers[0])) > 1
    assert frequent_words(docs.limit(0)) == []
