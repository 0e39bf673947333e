"""Shared by the tests of the training-data operators."""

#: Further columns whose names the operators use inside.
CLASHES = ("rep", "cls", "key", "words", "text_key", "n", "a", "b", "component", "rank", "score", "signature", "low")


def lines(df):
    return sorted(map(tuple, df.collect()), key=str)
