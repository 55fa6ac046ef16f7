import random
import sqlite3

import pytest

from tessera.errors import UsageError
from tessera.functions import markdown
from tessera.functions import snippets as S
from tessera.functions.passages import DEFAULT, chunking_of, chunking_text, count_words, normalize_chunking, split_passages
from tessera.functions.text import all_tokens, content_tokens, is_stopword, keyword_terms, porter, query_terms, stem_tokens


def test_stems_and_folding_equal_sqlite():
    text = "running_fast 3.14 C++ don't Café naïve 東京都 flies dies ties agreed plastered motoring sing hopping falling hissing failing filing happy sky relational conditional triplicate formative hopeful goodness revival allowance adoption probate rate cease controll roll"
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    db.execute("insert into f values (?)", (text,))
    want = [r[0] for r in db.execute("select term from v order by offset")]
    assert stem_tokens(text) == want
    assert porter("running") == "run" and porter("ab") == "ab"


def test_query_parsing():
    assert query_terms("The Cat the CAT's") == ["the", "cat", "s"]
    assert keyword_terms("what is wild yeast") == ["wild", "yeast"]
    assert keyword_terms("what is this") == ["what", "is", "this"]
    assert is_stopword("don't") and not is_stopword("yeast")
    assert content_tokens('"Wild" yeast WILD -- the') == ["Wild", "yeast"]
    assert all_tokens('a "b" a --') == ["a", "b", "a", "--"]


def test_chunking_settings():
    assert normalize_chunking("default") == DEFAULT and normalize_chunking(False) is None
    assert chunking_of(chunking_text(DEFAULT)) == DEFAULT and chunking_of("junk{") is None
    assert normalize_chunking(None) is None and normalize_chunking(" OFF ") is None and normalize_chunking(True) == normalize_chunking("on") == DEFAULT
    assert normalize_chunking({"max_words": 30}) == {"version": 1, "max_words": 30, "overlap_words": 15} and normalize_chunking('{"overlap_words": 0}')["overlap_words"] == 0
    for bad in ([], "[1]", "maybe", {"max_words": True}, {"max_words": 20.0}, {"max_words": 4001}, {"max_words": 15}, {"max_words": 20, "overlap_words": 11}, {"x": 1}, {"version": 2}, 3):
        with pytest.raises(UsageError):
            normalize_chunking(bad)


def test_passages():
    setting = {"version": 1, "max_words": 20, "overlap_words": 0}
    words = [f"w{i}." for i in range(41)]
    assert split_passages(" ".join(words[:20]), setting) == [" ".join(words[:20])]
    assert len(split_passages(" ".join(words[:21]), setting)) == 2
    assert " ".join(split_passages(" ".join(words), setting)) == " ".join(words)
    assert split_passages("x" * 500, setting) == ["x" * 500] and split_passages(None, setting) == [""]
    assert count_words("ab 東京 c") == 4
    over = split_passages(" ".join(words), {"version": 1, "max_words": 20, "overlap_words": 5})
    assert over[1].split()[:5] == over[0].split()[-5:]
    body = "\n".join(["one two three four five six seven eight nine ten eleven twelve.", "# Head", "alpha beta gamma delta epsilon zeta eta theta iota kappa."])
    assert not any(p.endswith("# Head") for p in split_passages(body, setting))


def test_passages_are_slices_in_order():
    rng = random.Random(7)
    for _ in range(40):
        body = "".join(rng.choice(["word ", "a. ", "\n", "# h\n", "- item\n", "end! ", "語"]) for _ in range(300))
        at = 0
        for p in split_passages(body, {"version": 1, "max_words": 24, "overlap_words": 6}):
            found = body.find(p, max(0, at))
            assert found >= 0 and p
            at = found
            assert count_words(p) <= 24 + 12


def lit(text, query, **more):
    return [s["text"] for s in S.segments_with_terms(text, query, **more) if s["highlight"]]


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("running", "run runs runner running rune ran", "run runs runner running"), ("studies", "study studied studying student", "study studied studying"),
        ("notes", "note noted notes nothing", "note noted notes"), ("renew", "Renewals are renewed; the renewal fee", "Renewals renewed renewal"),
        ("boxes", "a box, two boxes", "box boxes"), ("class", "classes in class, classic", "classes class classic"), ("run", "run rune runway", "run"),
        ("cat", "Cat, concatenate, CAT and cats.", "Cat CAT cats"), ("cafe", "Visit the Café today", "Café"), ("straße", "Die STRASSE ist lang", "STRASSE"),
        ("don't", "I don’t know", "don’t"), ("ΕΛΛΗΝΙΚΆ", "Ελληνικά κείμενα", "Ελληνικά"), ("a", "a b c", ""), ('"" () :', "some text", ""),
    ],
)
def test_words_that_light_up(query, text, want):
    assert lit(text, query) == want.split()
    assert "".join(s["text"] for s in S.segments_with_terms(text, query)) == text


def test_segments():
    assert S.stem("Owner's") == S.stem("owner")
    assert S.segments_with_terms("   \n\t ", "q") == []
    assert "".join(s["text"] for s in S.segments_with_terms("alpha\n\n  beta\tgamma", "beta")) == "alpha beta gamma"
    many = " ".join(["orbit"] * (S.MAX_HIGHLIGHTS + 50))
    assert len(lit(many, "orbit", max_chars=10_000)) == S.MAX_HIGHLIGHTS
    cut = "".join(s["text"] for s in S.segments_with_terms("word " * 400, "word", max_chars=103))
    assert cut.endswith(" …") and len(cut) <= 105 and set(cut[:-2].split()) == {"word"}
    assert S.segments_from_marks(None) == S.segments_from_marks("") == [{"text": "", "highlight": False}]
    assert S.segments_from_marks(f"a {S.MARK_ON}open")[1] == {"text": "open", "highlight": True}
    assert S.segments_from_marks(f"{S.MARK_OFF}tail") == [{"text": "tail", "highlight": False}]
    assert S.segments_with_terms("", "x") == []
    assert not any(s["highlight"] for s in S.segments_with_terms("the cat", "the dog"))
    a, b = S.MARK_ON, S.MARK_OFF
    assert S.segments_from_marks(f"a {a}b{b} c") == [{"text": "a ", "highlight": False}, {"text": "b", "highlight": True}, {"text": " c", "highlight": False}]


def test_best_passage():
    body = "\n".join(f"Line {i} about nothing much at all." for i in range(60)) + "\nHere wild yeast ferments slowly.\n" + "filler words here. " * 40
    got = S.best_passage(body, "wild yeast", 120)
    assert "wild yeast" in got and got.startswith("…") and got.endswith("…") and len(got) <= 124
    assert S.best_passage("# Title\n- item", "x") == "Title: item."
    assert S.best_passage("Line one.\n\nLine   two.", "two") == "Line one. Line two."
    assert S.units_of("> quoted **bold** [link](http://x) `code`\n|a|b|\n|-|-|\n***\n__init__ __so it is__") == ["quoted bold link code", "a: b.", "__init__ so it is"]
    far = "x " * 400_000 + "wild yeast."  # whole texts are read
    assert "wild yeast" in S.best_passage(far, "wild yeast", 120)
    filler = " ".join(f"filler{n}." for n in range(80))
    assert "beta" in S.best_passage(f"Alpha alpha alpha alpha. {filler} The alpha and beta pair appears here. {filler}", "alpha beta", 120)
    assert S.best_passage("", "x") == ""
    rng = random.Random(3)
    for _ in range(30):
        body = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta\n"]) for _ in range(300))
        got, whole = S.best_passage(body, "beta gamma", 90), " ".join(S.units_of(body))
        inner = got.strip("… ")
        at = whole.find(inner)
        assert at >= 0 and (not at or got[0] == "…") and (got[-1] == "…" or whole.endswith(inner))
        assert len(inner) <= 90 and set(inner.replace(".", "").split()) <= {"alpha", "beta", "gamma", "delta"}


def test_snippet_precedence():
    body = "First lines say little. " * 30 + "The compost drains water."
    assert any(s["highlight"] for s in S.build_snippet(body, "compost"))
    hint = S.build_snippet(body, "zebra", passage="The compost drains water.")
    assert "compost" in "".join(s["text"] for s in hint)
    marked = S.build_snippet(None, "yeast", marked=f"wild {S.MARK_ON}yeast{S.MARK_OFF}")
    assert [s["text"] for s in marked if s["highlight"]] == ["yeast"]


@pytest.mark.parametrize(
    ("line", "kind", "text"),
    [
        ("## Head ##", "heading", "Head"), ("   # three", "heading", "three"), ("    # four", "text", "# four"), ("#tag", "text", "#tag"), ("####### 7", "text", "####### 7"), ("#", "heading", ""),
        ("- a", "item", "a"), ("-a", "text", "-a"), ("* [x] done", "item", "done"), ("12) b", "item", "b"), ("1234567890. c", "text", "1234567890. c"), ("3.14", "text", "3.14"),
        ("> > - q", "item", "q"), (">plain", "text", "plain"), ("|a|b|", "row", "|a|b|"), ("```py", "fence", "py"), ("~~~", "fence", ""), ("``x``", "text", "``x``"), ("", "text", ""), ("--", "text", "--"),
    ],
)
def test_blocks_of_markdown(line, kind, text):
    assert markdown.content(line) == (kind, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a **b** *c* ***d*** ~~e~~ f", "a b c d e f"), ("2 * 3 * 4", "2 * 3 * 4"), ("snake_case_name __init__ _so it is_", "snake_case_name __init__ so it is"),
        ("[label](http://x/(1)) ![pic](y) [open](", "label pic [open]("), ("[**bold** [in](z)](w)!", "bold in!"), ("`a*b*` ``c`d`` `e", "a*b* c`d `e"), (r"\*no\* \a", r"*no* \a"),
        ("<http://x.y/z> a<b>c", "http://x.y/z a<b>c"), ("**open *mixed* text", "**open mixed text"), ("a ~b~ c", "a ~b~ c"), ("", ""), ("***", "***"),
    ],
)
def test_inline_markdown(text, want):
    assert markdown.plain(text) == want
