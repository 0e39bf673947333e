"""Texts put together from known parts: what each function must find follows
from how the text was built."""

import random
import re

from pyspark.sql import functions as F

from chemscore.functions import text as X

#: White space in Python's sense, including characters Java's \s leaves out.
SPACES = [" ", "\n", "\r", "\t", "\x1c", "\x1f", " ", " ", "\x85", "　"]
NAMES = ["LogP", "MW", "Polar Surface", "ring_count", "h-bond", "été", "x1"]
STATUS = {"improve": 1, "Improved": 1, "not improve": 1, "IMPROVES a lot": 1, "worse": -1, "none": -1, "imp rove": -1}
ANSWERS = ["True", "False", "it is True", "a, b: c", ""]


def pad(rnd, s):
    before, after = ("".join(rnd.choice(SPACES) for _ in range(rnd.randint(0, 2))) for _ in range(2))
    return before + s + after


def build(rnd):
    """(text, claims, parts in a one-line block or None, format holds, answer, greedy answer)."""
    claims, items = [], []
    for _ in range(rnd.randint(1, 12)):
        kind = rnd.random()
        name = rnd.choice(NAMES)
        if kind < 0.7:
            status = rnd.choice(list(STATUS))
            items.append(pad(rnd, name) + ":" + pad(rnd, status))
            claims.append((name, STATUS[status]))
        else:                                                  # no colon, two colons, blank: not a claim
            items.append(rnd.choice([pad(rnd, name), f"{name}: improve: {name}", pad(rnd, "")]))
    body = ",".join(items)
    between = pad(rnd, "")
    answer, second = rnd.choice(ANSWERS), rnd.choice(["", "later"])
    text = rnd.choice(["", "so ", "<think>x</think>"]) + f"<name>{body}</name>"
    joined = rnd.random() < 0.6
    text += between if joined else between + "because "
    text += f"<answer>{pad(rnd, answer)}</answer>"
    greedy = answer
    if second:
        tail = f" and <answer>{second}</answer>"
        start = text.index("<answer>") + len("<answer>")
        text += tail
        greedy = text[start:-len("</answer>")].strip("".join(SPACES))
    one_line = len(items) if "\n" not in body else None
    return text, claims, one_line, joined, answer, greedy


def test_texts_built_from_parts(spark):
    rnd = random.Random(4321)
    built = [build(rnd) for _ in range(400)]
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(built)], "i int, s string")
    rows = df.select("i", X.extract_answer("s").alias("a"), X.extract_answer("s", greedy=True).alias("ag"),
                     X.reward_format("s").alias("f"), X.reward_choice_count("s").alias("n"),
                     X.parse_claims("s").alias("cl")).collect()
    for r in rows:
        text, claims, one_line, joined, answer, greedy = built[r.i]
        assert [(c.prop, c.label) for c in r.cl] == claims, repr(text)
        assert (r.a, r.ag) == (answer, greedy), repr(text)
        assert r.f == (1.0 if joined else -2.0), repr(text)
        want = -1.5 if one_line is None else 0.0 if one_line in range(3, 11) else -1.0
        assert r.n == want, repr(text)


def test_padding_is_stripped_and_last_word_found(spark):
    rnd = random.Random(99)
    cores = ["", "a", "a b", "CC(=O)O", "x　y", "p q r"]
    rows = [(i, i % len(cores), pad(rnd, cores[i % len(cores)])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, k int, s string")
    last = [None, "a", "b", "CC(=O)O", "y", "r"]
    for r in df.select("k", X.unicode_strip("s").alias("st"), X.extract_smiles_text("s").alias("sm")).collect():
        assert (r.st, r.sm) == (cores[r.k], last[r.k])


def test_hash_answers_and_names(spark):
    df = spark.createDataFrame([("q #### 42", "42"), ("#### a b\t#### z", "a b"), ("none ###", None), ("####", "")],
                               "s string, want string")
    assert all(r.h == r.want for r in df.select("want", X.extract_hash_answer("s").alias("h")).collect())
    names = spark.createDataFrame([("Polar Surface_Area", "polarsurfacearea"), ("H-Bond", "hbond"), ("É t", "ét")],
                                  "s string, want string")
    assert all(r.n == r.want for r in names.select("want", X.normalize_name(F.col("s")).alias("n")).collect())


#: What hostile texts are put together from: tags in any order, broken ones, white space of all kinds.
PIECES = ["<name>", "</name>", "<answer>", "</answer>", "<name", "name>", "<<name>", "</answer", "a", "True", ",", ":", ", b: improve",
          "not improve", "\n", " ", "\t", "\x1c", "\x85", " ", "　", "​", "é", "\U0001f600", "\r"]


def by_regex(text):
    """(answer, name block, format, one-line count, count, raw claims) as the regexes of the reference give them."""
    found = lambda p, flags=re.S: (m := re.search(p, text, flags)) and m.group(1)
    answer, block, line = found("<answer>(.*?)</answer>"), found("<name>(.*?)</name>"), found(r"<name>([^\n]*?)</name>", 0)
    holds = re.search(r"<name>.*?</name>\s*<answer>.*?</answer>", text, re.S) is not None
    items = [x.strip() for x in (block or "").strip().split(",")]
    claims = [(x.split(":")[0].strip(), 1 if "improve" in x.split(":")[1].strip().lower() else -1) for x in items if x and x.count(":") == 1]
    count = lambda b: None if b is None else len(b.split(","))
    return (answer or "").strip(), None if block is None else block.strip(), holds, count(line), count(block), claims


def test_cuts_equal_the_regexes(spark):
    rnd = random.Random(77)
    texts = ["".join(rnd.choice(PIECES[:9] if rnd.random() < 0.5 else PIECES) for _ in range(rnd.randint(0, 24))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select(
        "i", X.extract_answer("s").alias("a"), X.extract_name_block("s").alias("b"), X.reward_format("s").alias("f"),
        X.choice_count("s").alias("one"), X.choice_count("s", dotall=True).alias("all"), X.parse_claims("s").alias("c")).collect()
    held = 0
    for r in rows:
        got = (r.a, r.b, r.f == 1.0, r.one, r["all"], [(c.prop, c.label) for c in r.c])
        assert got == by_regex(texts[r.i]), repr(texts[r.i])
        held += got[2]
    assert held > 20
