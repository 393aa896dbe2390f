"""Text and array functions against Python, on the inputs of FIXTURES C."""

import re

import pytest
from lodestone.functions import arrays as A
from lodestone.functions import metrics as M
from lodestone.functions import text as S
from lodestone.operators.tokenizer import chunks, split_python
from pyspark.sql import functions as F

FENCED = "Sure.\n```python\ndef add(a, b):\n    return a + b\n```\nDone!"
BARE = "Here it is\nimport os\nprint(os.name)"
TWO = "a\n```\nx = 1\n```\nb\n```python\ny = 2\n```\nc"
OTHER = "see\n```js\nlet a\n```\ntail"
TEXTS = [FENCED, BARE, TWO, OTHER, "no code here", "", "prose \u00a0 with\u3000wide spaces", "```\n\n```"]


def one(spark, column, *values):
    """The column's value for each of the values, as column c."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_line_numbers_and_back(spark):
    code = "a\n\nb\n"
    (got,) = one(spark, S.line_numbers(F.col("c")), code)
    assert got == "\n".join(f"{i + 1:>5}→{x}" for i, x in enumerate(code.split("\n")))
    assert one(spark, S.strip_line_numbers(F.col("c")), got) == [code]


def test_filenames(spark):
    assert one(spark, S.infer_filename(F.col("c"), F.lit(7)), "def foo (x)", "class Bar:", "x = 1", "class A:\n  def été(): 1") == ["foo.py", "bar.py", "solution_7.py", "été.py"]


@pytest.mark.parametrize("lower", [True, False])
def test_first_fence(spark, lower):
    column = S.extract_chat_code(F.col("c")) if lower else S.extract_pair_code(F.col("c"))
    for text, got in zip(TEXTS, one(spark, column, *TEXTS), strict=True):
        m = re.search(r"```(?:python)?\s*\n(.*?)```", text, re.DOTALL)
        if m:
            want = (text[: m.start()].strip(), m[1].strip(), text[m.end() :].strip())
            assert tuple(got) == ((want[0].lower(), want[1], want[2].lower()) if lower else want)
        elif not lower:
            assert got is None
        elif text != BARE:
            assert tuple(got) == ("", "", "")
    if lower:
        assert tuple(one(spark, column, BARE)[0]) == ("here it is", "import os\nprint(os.name)", "")


def test_field_code_and_blocks(spark):
    assert tuple(one(spark, S.extract_field_code(F.col("c")), TWO)[0]) == ("a\n\nb\n\nc", "x = 1")
    assert tuple(one(spark, S.extract_field_code(F.col("c")), BARE)[0]) == (BARE, "")
    assert tuple(one(spark, S.extract_field_code(F.col("c"), True), "#! /bin/x\ny")[0]) == ("", "#! /bin/x\ny")
    assert one(spark, S.fenced_blocks(F.col("c")), TWO, "```\n\n```") == [["x = 1", "y = 2"], []]


def test_share_of_ascii(spark):
    assert one(spark, S.is_english(F.col("c")), "plain", "éééééé", "", "```python\nété\n```") == [True, False, True, True]


def test_grep(spark):
    code = "class A:\n    def __init__(self): pass\ndef __init__(): 1\ndef go(x):\n    return 1\n\nz = 2"
    assert tuple(one(spark, S.grep_target(F.col("c")), code)[0]) == ("class", "A")
    got = one(spark, S.grep_result(F.struct(F.lit("def").alias("keyword"), F.lit("go").alias("name")), F.lit("f.py"), F.col("c"), F.lit(1)), code)[0].split("\n")
    assert got[0] == "f.py:4:def go(x):" and 3 <= len(got) <= 4


def test_tool_call(spark):
    got = one(spark, S.parse_tool_call(F.col("c")), "Read<|tool_arg|> file_path <|tool_val|> a.py <|tool_arg|>limit<|tool_val|>-12")[0]
    assert got["name"] == "Read" and [tuple(a) for a in got["args"]] == [("file_path", "a.py", None), ("limit", "-12", -12)]


def test_answers_and_ansi(spark):
    assert one(spark, S.clean_answer(F.col("c")), "<think>a\nb</think>\n```json\n{}\n```", "plain") == ["{}", "plain"]
    assert one(spark, S.strip_ansi(F.col("c")), "\x1b[92mok\x1b[0m") == ["ok"]


def test_pre_split_equals_python(spark):
    texts = ["Hello world! 12345", "I'LL it's we've", "a\u00a0b\u3000c  d \n\n e", "x = {1: 'é'}\r\n\t🙂🙂 end   ", ""]
    assert one(spark, chunks(F.col("c")), *texts) == [split_python(t) for t in texts]


def test_common_lengths(spark):
    df = spark.createDataFrame([([[1, 2, 3], [1, 2, 4, 3]],), ([[1], [1]],), ([[], [1]],)], "s array<array<int>>")
    got = df.select(A.common_length(F.col("s")), A.common_length(F.col("s"), from_right=True)).collect()
    assert [tuple(r) for r in got] == [(2, 1), (1, 1), (0, 0)]


def test_masks_padding_shift(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [0, 0, 1, 1])], "ids array<int>, m array<int>")
    ids = F.col("ids")
    r = df.select(A.choice_mask(ids, F.lit(1)), A.suffix_mask(ids, F.lit(3)), A.pad(ids, F.lit(6), 0), A.shift(ids, F.col("m")), A.bucket(F.size(ids)), A.keep_tail(ids, 2), A.splice(ids, F.lit(2), F.array(F.lit(9))), A.chunked(ids, 3)).first()
    assert r[0] == [0, 1, 1, 1] and r[1] == [0, 1, 1, 1] and r[2] == [5, 6, 7, 8, 0, 0]
    assert r[3]["inputs"] == [5, 6, 7] and r[3]["targets"] == [-1, 7, 8] and r[4] == 128
    assert r[5] == [7, 8] and r[6] == [5, 9, 6, 7, 8] and r[7] == [[5, 6, 7], [8]]


def test_metrics(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0, 2), (1, nan, 1), (2, 0.1, 1)], "choice int, loss double, n int")
    assert df.agg(M.first_least(F.col("choice"), F.col("loss"), F.col("n"))).first()[0] == 1  # NaN is least
    assert df.filter("n = 9").agg(M.accuracy(F.col("loss") > 0), M.bits_per_byte(F.col("loss"), F.col("n")), M.all_match(F.col("n"), F.col("n"), F.lit(True))).first()[:] == (0.0, float("inf"), True)
    assert spark.range(1).select(M.centered(F.lit(0.625), F.lit(25.0))).first()[0] == pytest.approx(0.5)
    assert M.training_steps(8, 100, 3) == 268
