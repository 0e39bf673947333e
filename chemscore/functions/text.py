"""Column -> Column text functions for tagged completions.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
none needs Python.  Python-vs-Java regex differences are handled explicitly:

* Python's ``str.strip``/``split``/``\\s`` use Unicode whitespace plus the
  separators U+001C..U+001F; Java's ``\\s`` is ASCII unless ``(?U)`` is set, so
  we use ``(?U)[\\s\\x1c-\\x1f]``.
* Python's ``.`` without DOTALL stops only at ``\\n``; Java's also at ``\\r``,
  U+0085, U+2028/9, so single-line spans are written ``[^\\n]``.
* ``regexp_extract`` returns ``''`` on no match; where "absent" differs from
  "empty" we pair it with ``rlike``.

A lazy span ``<tag>(.*?)</tag>`` under DOTALL is the text between the first
opening tag and the first closing tag after it, so it is cut out by plain search
(``after``, ``before``); regexes are left for what search cannot decide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"            # used under (?U)
# Python's whitespace set, derived from the rule itself (str.isspace), for btrim
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
_STRIP_RE = rf"(?U)^{WS}+|{WS}+\z"
_WS_RUN_RE = rf"(?U){WS}+"

ANSWER_GREEDY = r"(?s)<answer>(.*)</answer>"
NAME_LINE = r"<name>([^\n]*?)</name>"
FORMAT_RE = rf"(?sU)<name>.*?</name>{WS}*<answer>.*?</answer>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_strip(c) -> Column:
    """Python ``str.strip()``; Spark's one-argument ``trim`` only removes
    U+0020, so we trim the exact set of characters ``str.isspace`` accepts
    (a codegen'd loop, no regex)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def after(c, tag: str) -> Column:
    """The text after the first ``tag``; NULL when there is none."""
    cc = _c(c)
    return F.when(cc.contains(tag), F.substring(cc, F.locate(tag, cc) + F.lit(len(tag)), F.lit(2**31 - 1)))


def before(c, tag: str) -> Column:
    """The text before the first ``tag``; NULL when there is none."""
    return F.when(_c(c).contains(tag), F.substring_index(_c(c), tag, 1))


def extract_answer(c, greedy: bool = False, rest=None) -> Column:
    """X1 / X1g: body of the first ``<answer>`` up to the first (or, greedy, the
    last) ``</answer>``, across newlines, stripped; ``''`` when absent.
    ``rest``: the text after the first ``<answer>``, if it is at hand."""
    cc = _c(c)
    if greedy:
        body = F.when(cc.contains("</answer>"), F.regexp_extract(cc, ANSWER_GREEDY, 1))
    else:
        body = before(after(cc, "<answer>") if rest is None else rest, "</answer>")
    return F.coalesce(unicode_strip(body), F.lit(""))


def name_block(c) -> Column:
    """The body of the first ``<name>..</name>`` as it stands; NULL when there is none."""
    return before(after(c, "<name>"), "</name>")


def extract_name_block(c) -> Column:
    """Stripped body of the first ``<name>..</name>``; NULL when there is none."""
    return unicode_strip(name_block(c))


def claim_status(status, negation_aware: bool = False) -> Column:
    """+1 when the lowered status contains ``improve`` (so ``not improve`` is
    +1 too, as in the reference), else -1.  ``negation_aware`` tests the
    negation first."""
    s = F.lower(unicode_strip(_c(status)))
    if negation_aware:
        return (F.when(s.contains("not improve"), F.lit(-1))
                .when(s.contains("improve"), F.lit(1)).otherwise(F.lit(-1)))
    return F.when(s.contains("improve"), F.lit(1)).otherwise(F.lit(-1))


def claim_items(c) -> Column:
    """P6 (first half): comma items of the name block, stripped, blanks dropped."""
    body = F.coalesce(extract_name_block(c), F.lit(""))
    items = F.transform(F.split(body, ",", -1), lambda x: unicode_strip(x))
    return F.filter(items, lambda x: x != F.lit(""))


def claim_pairs(c) -> Column:
    """``ARRAY<STRUCT<prop, status>>``: items with exactly one ``:``, both sides stripped."""
    parts = F.transform(claim_items(c), lambda x: F.split(x, ":", -1))
    kept = F.filter(parts, lambda p: F.size(p) == 2)
    return F.transform(kept, lambda p: F.struct(unicode_strip(p.getItem(0)).alias("prop"),
                                               unicode_strip(p.getItem(1)).alias("status")))


def _commas(c: Column, sign: str = ",") -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(sign), F.lit("")))


def raw_claims(block) -> Column:
    """The comma items of a ``name_block`` with exactly one ``:`` (P6), as they stand."""
    return F.filter(F.split(F.coalesce(_c(block), F.lit("")), ",", -1), lambda x: _commas(x, ":") == 1)


def raw_name(item) -> Column:
    """The name of a raw claim, as it stands."""
    return F.substring_index(_c(item), ":", 1)


def raw_label(item, negation_aware: bool = False) -> Column:
    """X4 of a raw claim; white space around a status cannot make or break a word of it."""
    status = F.lower(F.substring_index(_c(item), ":", -1))
    improves = status.contains("improve")
    if negation_aware:
        improves = improves & ~status.contains("not improve")
    return F.when(improves, F.lit(1)).otherwise(F.lit(-1))


def parse_claims(c, negation_aware: bool = False) -> Column:
    """``ARRAY<STRUCT<prop STRING, label INT>>`` from the name block.

    Items without exactly one ``:`` are dropped (P6); names are stripped; the
    label follows X4.
    """
    return F.transform(raw_claims(name_block(c)), lambda x: F.struct(
        unicode_strip(raw_name(x)).alias("prop"), raw_label(x, negation_aware).alias("label")))


def normalize_name(c) -> Column:
    """Lower-case, then delete spaces, underscores and hyphens."""
    return F.translate(F.lower(_c(c)), " _-", "")


def task_from_system(content) -> Column:
    """X6 core: task keyword test on a system message."""
    s = F.lower(F.coalesce(_c(content), F.lit("")))
    return (F.when(s.contains("bbbp"), F.lit("BBBP"))
            .when(s.contains("bace"), F.lit("BACE"))
            .when(s.contains("toxic"), F.lit("Clintox"))
            .otherwise(F.lit("UNKNOWN_TASK")))


def extract_task(prompt) -> Column:
    """Task of a prompt ``ARRAY<STRUCT<role, content>>`` from its first
    system message; ``UNKNOWN_TASK`` when there is none."""
    system = F.get(F.filter(_c(prompt), lambda m: m["role"] == F.lit("system")), 0)
    return F.when(system.isNull(), F.lit("UNKNOWN_TASK")).otherwise(task_from_system(system["content"]))


def extract_smiles_text(content) -> Column:
    """X7 core: last whitespace token of a user message; NULL when blank."""
    tokens = F.split(unicode_strip(F.coalesce(_c(content), F.lit(""))), _WS_RUN_RE, -1)
    return F.nullif(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def extract_smiles(prompt) -> Column:
    """From message index 1 of a prompt array (NULL when it is missing)."""
    return extract_smiles_text(F.get(_c(prompt), 1)["content"])


def extract_hash_answer(c) -> Column:
    """Text between the first and second ``####``, stripped; NULL if absent."""
    return F.when(_c(c).contains("####"),
                  unicode_strip(F.get(F.split(_c(c), "####", -1), 1)))


def py_str(c) -> Column:
    """``str(x)`` for a string column: NULL renders as ``None``."""
    return F.coalesce(_c(c), F.lit("None"))


def format_template(name, answer) -> Column:
    """The name/answer XML template filled in (Python ``str.format``)."""
    nl = "\n"
    return F.concat(F.lit(f"{nl}<name>{nl}"), py_str(name), F.lit(f"{nl}</name>{nl}<answer>{nl}"),
                    py_str(answer), F.lit(f"{nl}</answer>{nl}"))


def assemble_prompt(system_content, user_content) -> Column:
    """``[{system, instruction}, {user, input}]``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), _c(system_content).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(user_content).alias("content")))


# ----- reward cores (R1-R3) ---------------------------------------------------

def reward_format(c, tail=None) -> Column:
    """1.0 when a name block is followed by only whitespace and an answer
    block, else -2.0.  Decided at the first ``</name>`` after the first
    ``<name>``; only a text with a further ``</name>`` needs the regex.
    ``tail``: the text after that ``</name>``, if it is at hand."""
    cc = _c(c)
    tail = after(after(cc, "<name>"), "</name>") if tail is None else _c(tail)
    answer = F.ltrim(tail, F.lit(PY_WHITESPACE))
    ok = (F.when(~tail.contains("</answer>"), F.lit(False))
          .when(answer.startswith("<answer>"), F.lit(True))
          .when(tail.contains("</name>"), cc.rlike(FORMAT_RE)))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(1.0)).otherwise(F.lit(-2.0))


def reward_correctness(extracted, answer, exact: bool = False) -> Column:
    """R2: 2.0 when the ground truth is a substring of the extracted answer
    (``exact`` compares whole strings), else 0.0; a NULL answer gives 0.0."""
    hit = (_c(extracted) == _c(answer)) if exact else _c(extracted).contains(_c(answer))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(2.0)).otherwise(F.lit(0.0))


def choice_count(c, dotall: bool = False, block=None) -> Column:
    """Number of comma parts in the first name block (single-line unless
    ``dotall``); NULL when there is no such block.  ``block``: the text's
    ``name_block``, if it is at hand."""
    block = name_block(c) if block is None else _c(block)
    if dotall:
        return _commas(block) + F.lit(1)
    line = F.when(_c(c).rlike(NAME_LINE), F.regexp_extract(_c(c), NAME_LINE, 1))
    # the first block of several lines: a later one may stand on one line
    return F.when(~block.contains("\n"), _commas(block) + F.lit(1)).when(block.isNotNull(), _commas(line) + F.lit(1))


def reward_choice_count(c, min_number: int = 3, max_number: int = 10, dotall: bool = False, block=None) -> Column:
    """0.0 when the count is within [min, max], -1.0 outside, -1.5 without a block."""
    n = choice_count(c, dotall, block)
    return (F.when(n.isNull(), F.lit(-1.5))
            .when(n.between(min_number, max_number), F.lit(0.0))
            .otherwise(F.lit(-1.0)))
