"""The gate in front of the residue rules lets through whatever a rule accepts."""

import itertools
import re
from re import _constants as c
from re import _parser

import pytest

pytest.importorskip("ahocorasick")
from tidemark.llm.residue import FILLER, LATIN, ONCE, SLOT, WIDELY, _signs, messages_of, needles, residue_documents, unfilled_slot

PHRASES = [r for rules in (*ONCE.values(), *WIDELY.values()) for r in rules]
RULES = [*SLOT, *PHRASES]
DOCS = "doc_id bigint, text string, source string"


def letter(items) -> str:
    """A character of a set."""
    no = [x[1] for x in items if x[0] is not c.NEGATE]
    if items[0][0] is c.NEGATE:
        out = {chr(v) for op, v in items[1:] if op is c.LITERAL} | {chr(x) for op, v in items[1:] if op is c.RANGE for x in range(v[0], v[1] + 1)}
        return next(x for x in "qé" if x not in out)
    first = no[0]
    return chr(first if isinstance(first, int) else first[0])


def examples(parsed, groups) -> list[str]:
    """Texts that hold each alternative of a rule at least once, options left out and taken."""
    out = [""]
    for op, v in parsed:
        if op is c.LITERAL:
            parts = [chr(v)]
        elif op in (c.NOT_LITERAL, c.ANY):
            parts = ["é"]
        elif op is c.IN:
            parts = [letter(v)]
        elif op is c.BRANCH:
            parts = [x for branch in v[1] for x in examples(branch, groups)]
        elif op is c.SUBPATTERN:
            parts = examples(v[3], groups)
            groups[v[0]] = parts[0]
        elif op is c.GROUPREF:
            parts = [groups[v]]
        elif op is c.MAX_REPEAT:
            low, high, inner = v
            parts = [x * n for x in examples(inner, groups) for n in {low, max(low, 1)}]
        else:  # anchors and lookarounds
            parts = [""]
        parts = list(dict.fromkeys(parts))
        if len(out) * len(parts) <= 300:
            out = [a + b for a, b in itertools.product(out, parts)]
        else:  # each on both sides once
            out = [a + parts[i % len(parts)] for i, a in enumerate(out)] + [out[i % len(out)] + b for i, b in enumerate(parts)]
    return list(dict.fromkeys(out))


def test_every_alternative_of_every_rule_passes_the_gate():
    signs, lost, bare = _signs(), [], []
    for rule in RULES:
        held = [t for e in examples(_parser.parse(rule), {}) for t in (e, f"a {e}", f"{e} a") if re.search(rule, t)]
        if not held:
            bare.append(rule)
        # the rules see messages one by one; only those which the rule accepts after splitting can count
        lost += [(rule, t) for t in held if not any(re.search(rule, m) for m in messages_of(t, signs)) and len(re.split(r"(?<=[.!?…]) |\n|(?<=。)", t)) == 1 and "@" not in t and t == " ".join(t.split()) and t.lstrip("-*> ") == t]
    assert bare == [] and lost == []


def test_needles_are_in_whatever_a_rule_accepts():
    """Each text a rule accepts holds one of the literals that were derived from the rule."""
    for rule in RULES:
        found = needles(rule, masked=rule not in SLOT)
        if rule == FILLER[1] or r"\1" in rule:
            continue  # four words of Latin and repeated words have a count of their own
        assert found and all(found), rule
        for text in examples(_parser.parse(rule), {}):
            if re.search(rule, text):
                assert any(x in text for x in found), (rule, text)


def test_any_four_words_of_filler_latin_pass_the_gate():
    signs = _signs()
    for i in range(len(LATIN)):
        for step in (1, 3, 7):
            text = " ".join(LATIN[(i + j * step) % len(LATIN)] for j in range(4))
            assert set(messages_of(text, signs)) == {text}
    for text in ("Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "dolor sit amet, consectetur adipiscing elit, sed do eiusmod"):
        assert messages_of(text, signs)
    assert not messages_of("A temporary minimum of animals.", signs)


def test_resets_and_blocks_that_recur_are_found(spark):
    texts = ["The connection was reset.", "Request has been blocked.", "The request was refused.", "Sint sunt culpa anim est."]
    rows = [(10 * i + k, t, f"s{k}") for i, t in enumerate(texts) for k in range(2)] + [(99, "The reset was quick; he refused and blocked it.", "s")]
    assert {r.doc_id for r in residue_documents(spark.createDataFrame(rows, DOCS)).collect()} == {0, 1, 10, 11, 20, 21, 30, 31}


# Phrases that stand in no rule and no test table: what pages say is put together from parts.
HELD_OUT = [
    "This site can't be reached", "Page cannot be displayed", "502 Bad Gateway nginx", "The web page could not be opened.", "Sorry, the document you requested is no longer available.",
    "Oops! Something went wrong.", "The upstream server did not respond.", "This service is temporarily unavailable.", "Too many attempts, slow down.", "The download has failed.",
    "Placeholder heading", "Text to follow", "Under construction", "Click here to edit text", "Cookies must be enabled to go on.", "One moment, we are checking your connection",
]
ALONE = ["Welcome to [Company Name]!", "Dear {{ first_name }}, thanks for your order.", "Regards, [Your Name]", "Total: ${order.total}", "{{" + "x" * 500 + "}}", "[insert " + "very " * 60 + "long note]"]
EXPLAINED = ["In LaTeX, write {name} to group.", "Use ${HOME} in your shell", "The slot {ticker} is replaced by the symbol.", "Type %USERPROFILE% in a script", "See [the date](https://a.b/c).", "Rates of [1] and [2] differ."]
REPORTED = ["On Monday the page could not be opened, and we told the vendor.", "He asked whether the server was closed.", "Ticket 7: the reader saw 'This site can't be reached' twice.", "We found that the connection was reset by the router at noon."]


def test_held_out_phrases(spark):
    rows = [(100 * i + k, t, f"s{k}") for i, t in enumerate(HELD_OUT) for k in range(2)]
    rows += [(10_000 + i, t, "s") for i, t in enumerate(ALONE)] + [(20_000 + i, t, "s") for i, t in enumerate(EXPLAINED + REPORTED)]
    found = {r.doc_id for r in residue_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert [t for i, t in enumerate(HELD_OUT) if 100 * i not in found] == []
    assert [t for i, t in enumerate(ALONE) if 10_000 + i not in found] == []
    assert [t for i, t in enumerate(EXPLAINED + REPORTED) if 20_000 + i in found] == []


def test_a_phrase_that_stands_once_does_not_recur(spark):
    rows = [(i, t, "s") for i, t in enumerate(HELD_OUT[:3] + HELD_OUT[10:])]
    assert residue_documents(spark.createDataFrame(rows[:1], DOCS)).count() == 0
    assert {r.doc_id for r in residue_documents(spark.createDataFrame(rows + [(99, HELD_OUT[0], None)], DOCS)).collect()} >= {0, 99}


def test_slots_and_words_about_them():
    assert unfilled_slot("close of {date}") and unfilled_slot("use {a_b} of {ticker}")
    assert not unfilled_slot("the variable {ticker} stands for a symbol") and not unfilled_slot("plain text")
