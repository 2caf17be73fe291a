"""Hidden copies and texts that look the same."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm.canon import canonical, has_visible, same_look_pairs, with_canonical
from loamstone.llm.copies import collapsed, copy_members, field_form, named_fields, plain_form

REC = "id string, content string, parent_id string, owner_id string, label string"


def test_forms():
    assert plain_form("A, b\tC-1!") == plain_form("abc1") == "abc1"
    assert named_fields('{"a": "x", "b": 2}') == [("a", "x"), ("b", "2")]
    assert field_form("- a: X y\n- b: 2") == field_form("b=2 | a=x-y") == field_form('{"B":"2","A":"xy"}')
    assert field_form("a: x; b: y") != field_form("a: y; b: x")
    assert field_form("just prose; with parts") is None and field_form("one: field") is None
    assert field_form("{broken") is None and field_form("") is None


def test_copy_sets(spark):
    rows = [
        ("r3", "Hello, World", None, "o1", "x"),
        ("r1", "hello   world!", "", " O1 ", "x"),
        ("r1", "hello   world!", "", " O1 ", "x"),
        ("r2", "HELLO-WORLD", None, "o2", "x"),
        ("f1", "a: 1; b: 2", None, "o1", None),
        ("f2", "b = 2\na = 1", None, "o1", None),
        ("f3", "a 1 b 2", None, "o1", None),
        ("f4", "a: 2; b: 1", None, "o1", None),
        ("n1", None, None, "o1", None),
        ("n2", "   ", None, "o1", None),
        ("n3", "...", None, "o1", None),
        ("m1", "[user] hello world", None, "o1", None),
        ("p1", "hello world", "d", "o1", None),
        ("e1", "hello world", None, None, None),
        (None, "hello world", None, "o1", None),
        ("l1", "long " * 100000, None, "o1", None),
    ]
    df = spark.createDataFrame(rows, REC)
    got = {(r["representative"], r["id"], r["copies"]) for r in copy_members(df).collect()}
    assert got == {("r1", "r1", 2), ("r1", "r3", 2), ("f1", "f1", 3), ("f1", "f2", 3), ("f1", "f3", 3)}
    kept = {r["id"]: r["copies"] for r in collapsed(df).collect()}
    assert kept["r1"] == 2 and kept["f1"] == 3 and kept["f4"] == 1 and "r3" not in kept
    assert copy_members(df.limit(0)).count() == 0


def test_hot_copy_group(spark):
    df = spark.range(3000).selectExpr("concat('i', lpad(id, 6, '0')) AS id", "concat('Same text', repeat(' ', cast(id % 7 AS int))) AS content", "'' AS parent_id", "'o' AS owner_id", "1 AS label")
    got = copy_members(df)
    assert got.count() == 3000 and got.where("representative = 'i000000' AND copies = 3000").count() == 3000


def brute(text):
    """The form of a text, character by character, without segments."""
    from loamstone.llm import canon

    kept = []
    for ch in text:
        if ch in canon._JOINERS:
            if kept and (canon._is_pictograph(kept[-1]) or kept[-1] in canon._JOINERS):
                kept.append(ch)
        elif not canon._is_invisible(ch):
            kept.append(ch)
    wide = "".join(unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFFEE or 0x2160 <= ord(c) <= 0x217F else c for c in kept)
    plain = "".join(" " if unicodedata.category(c) == "Zs" else canon.LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", wide))
    return unicodedata.normalize("NFC", plain)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeoеоΑАｅｏ１²1  　̧́̈é​カｶﾞﾟ゙‍👩💻️\n\tIıß가ᄀ", max_size=24))
def test_segments_equal_whole_text(text):
    assert canonical(text) == brute(text)
    assert canonical(canonical(text)) == canonical(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12))
def test_segments_equal_whole_text_of_any_characters(text):
    if not any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in text):
        assert canonical(text) == brute(text)


def test_quick_check_is_that_of_composed_text():
    """Every character that may change composed text is unstable, and no ordinary letter is."""
    from loamstone.llm import canon

    for code in [*range(0x250), *range(0x300, 0x1200), *range(0x3040, 0x3100), *range(0xAC00, 0xAC80), *range(0x2F800, 0x2FA1E)]:
        ch = chr(code)
        if unicodedata.category(ch) != "Cn" and (unicodedata.normalize("NFC", ch) != ch or unicodedata.normalize("NFC", "e" + ch) != "e" + ch or unicodedata.combining(ch)):
            assert canon._is_unstable(code), hex(code)
    assert not any(canon._is_unstable(ord(c)) for c in "aZ9é漢かガ가ßжя.")


def test_more_scripts():
    assert canonical("αρɡɑꓮⅣ") == "apgaAIV"


def test_one_look_of_many_forms(spark, monkeypatch):
    from loamstone.llm import canon

    monkeypatch.setattr(canon, "BLOCK", 7)
    rows = [(k, "".join("аa"[k >> b & 1] for b in range(6))) for k in range(64)]
    df = spark.createDataFrame(rows, "arrival bigint, content string")
    got = same_look_pairs(df, "arrival").collect()
    assert len(got) == len({tuple(r) for r in got}) == 64 * 63 // 2


def test_nested_fields_in_any_order():
    assert field_form('{"a": {"x": 1, "y": "B"}, "c": 2}') == field_form('{"C": "2", "A": {"Y": "b", "x": 1}}') == field_form('c: 2; a: {"y": "b", "x": 1}')
    assert field_form('{"a": [1, 2], "c": 2}') != field_form('{"a": [2, 1], "c": 2}')


def test_looks():
    assert canonical("Ｔｅｓｔ") == canonical("Тest") == "Test"
    assert canonical("café") == canonical("caf​é") == "café"
    assert canonical("ﾊﾞｽ") == "バス"
    assert canonical("a b") == canonical("a b") != canonical("a  b")
    for a, b in (("a", "A"), ("x²", "x2"), ("é", "e"), ("!", "?")):
        assert canonical(a) != canonical(b)
    assert canonical("👩‍💻") != canonical("👩💻")
    assert canonical(None) is None and canonical("") == ""
    assert not has_visible("​ \t⠀\x00") and has_visible(" x") and not has_visible(None)


def test_pairs(spark):
    rows = [(1, "Test", "x"), (2, "Тest", "x"), (3, "Ｔest", None), (4, "Test", None), (5, "test", None), (6, None, None), (7, "​", None), (8, "", None), (None, "Test", None)]
    df = spark.createDataFrame(rows, "arrival bigint, content string, look string")
    got = {tuple(r) for r in same_look_pairs(df, "arrival").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert same_look_pairs(df.limit(0), "arrival").count() == 0
    assert with_canonical(df).where("arrival = 2").first()["canonical"] == "Test"
    long = spark.createDataFrame([(1, "a" * 10**6), (2, "а" * 10**6)], "arrival bigint, content string")
    assert same_look_pairs(long, "arrival").count() == 1
