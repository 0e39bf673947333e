"""DuckDB oracle SQL for the registered queries (the correctness gate).

Each string runs on the base tables only; the derived views are inlined as
CTEs.  Fragments mirror Python semantics the same way the Spark side does:
Unicode strip, lazy/greedy answer spans, single-line name blocks.  The
similarity stage has no SQL form, so claim-level oracles use the frozen
vocabulary of the fixture's ten property names (FIXTURES section 5/9).
"""

from __future__ import annotations

from chemscore.operators.trees import poisson_cuts
from chemscore.plans import dims
from chemscore.plans.views import duckdb_ctes

ORACLES: dict[str, str] = {}

# RE2 class for Python's str.isspace() characters
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Zs}\x{2028}\x{2029}]"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def NORM(x: str) -> str:
    return f"replace(replace(replace(lower({x}), ' ', ''), '_', ''), '-', '')"


def ANSWER(x: str, greedy: bool = False) -> str:
    body = "(.*)" if greedy else "(.*?)"
    return STRIP(f"regexp_extract({x}, '(?s)<answer>{body}</answer>', 1)")


def NAME_BLOCK(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '(?s)<name>(.*?)</name>') "
            f"THEN {STRIP(f'regexp_extract({x}, ' + chr(39) + '(?s)<name>(.*?)</name>' + chr(39) + ', 1)')} END")


def TASK(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'bbbp') THEN 'BBBP' WHEN contains(lower({x}), 'bace') THEN 'BACE' "
            f"WHEN contains(lower({x}), 'toxic') THEN 'Clintox' ELSE 'UNKNOWN_TASK' END")


def SMILES(x: str) -> str:
    return f"nullif(list_last(regexp_split_to_array({STRIP(f'coalesce({x}, {chr(39)}{chr(39)})')}, '{WS}+')), '')"


def R1(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '(?s)<name>.*?</name>{WS}*<answer>.*?</answer>') "
            f"THEN 1.0::DOUBLE ELSE -2.0::DOUBLE END")


def R3(x: str, dotall: bool = False) -> str:
    pat = "(?s)<name>(.*?)</name>" if dotall else r"<name>([^\n]*?)</name>"
    return (f"CASE WHEN NOT regexp_matches({x}, '{pat}') THEN -1.5::DOUBLE "
            f"WHEN len(string_split(regexp_extract({x}, '{pat}', 1), ',')) BETWEEN 3 AND 10 THEN 0.0::DOUBLE "
            f"ELSE -1.0::DOUBLE END")


def LABEL(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'improve') THEN 1 ELSE -1 END"


# the fixture's ten claimed names, resolved (FIXTURES section 5): frozen vocabulary
FROZEN_VOCAB = [
    ("logp", "MolLogP", "alias", "logp"),
    ("mw", "MolWt", "alias", "mw"),
    ("polarsurfacearea", "TPSA", "alias", "polarsurfacearea"),
    ("hbd", "NumHDonors", "alias", "hbd"),
    ("hba", "NumHAcceptors", "alias", "hba"),
    ("charge", "NumHAcceptors", "alias", "hba"),
    ("ringcount", "RingCount", "alias", "ringcount"),
    ("balaban", "BalabanJ", "alias", "balaban"),
    ("???", None, "none", None),
    ("solubility", "MolWt", "rdkit", "molecularweight"),
]

# the same names: best alias key with its similarity, and the similarity of the key that resolved it
FROZEN_RATIOS = [
    ('logp', 'logp', 1.0, 1.0),
    ('mw', 'mw', 1.0, 1.0),
    ('polarsurfacearea', 'polarsurfacearea', 1.0, 1.0),
    ('hbd', 'hbd', 1.0, 1.0),
    ('hba', 'hba', 1.0, 1.0),
    ('charge', 'hba', 0.444444, 0.444444),
    ('ringcount', 'ringcount', 1.0, 1.0),
    ('balaban', 'balaban', 1.0, 1.0),
    ('???', None, None, None),
    ('solubility', 'polarizability', 0.666667, 0.48),
]


def _vals(rows, cols):
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS v({', '.join(cols)})"


def _ctes_scoring() -> str:
    """views + claim rows + prompt fields + dictionaries."""
    views = duckdb_ctes("molecules", "descriptors_wide", "prompts", "completions").rstrip()
    tasks = ", ".join(f"('{t}')" for t in dims.TASKS)
    return views + f""",
nb AS (SELECT prompt_id, gen_idx, coalesce({NAME_BLOCK('completion')}, '') AS body FROM completions),
it AS (SELECT prompt_id, gen_idx, unnest(string_split(body, ',')) AS raw_item,
              generate_subscripts(string_split(body, ','), 1) AS idx FROM nb),
it2 AS (SELECT prompt_id, gen_idx, idx, {STRIP('raw_item')} AS item FROM it),
it3 AS (SELECT prompt_id, gen_idx, idx, item, string_split(item, ':') AS parts FROM it2 WHERE item <> ''),
cl AS (SELECT prompt_id, gen_idx,
              CAST(row_number() OVER (PARTITION BY prompt_id, gen_idx ORDER BY idx) - 1 AS BIGINT) AS pos,
              {STRIP('parts[1]')} AS prop, {STRIP('parts[2]')} AS status
       FROM it3 WHERE len(parts) = 2),
cl2 AS (SELECT *, CAST({LABEL('status')} AS BIGINT) AS label, {NORM('prop')} AS norm FROM cl),
pf AS (SELECT prompt_id, {TASK('system_content')} AS task, {SMILES('user_content')} AS smiles, answer FROM prompts),
voc AS (SELECT * FROM {_vals(FROZEN_VOCAB, ['norm', 'descriptor', 'stage', 'matched_key'])}),
vt AS (SELECT voc.*, t.task FROM voc CROSS JOIN (VALUES {tasks}) AS t(task)),
rg AS ({dims.sql_ranges()}),
reg AS ({dims.sql_registry()}),
u AS (UNPIVOT descriptors_wide ON COLUMNS(* EXCLUDE (smiles)) INTO NAME nm VALUE val),
det AS (SELECT cl2.prompt_id, cl2.gen_idx, cl2.pos, cl2.prop, cl2.label, cl2.norm, pf.task, pf.smiles,
               coalesce(mo.valid, FALSE) AS valid, vt.descriptor, rg.lo, rg.hi,
               (reg.key IS NOT NULL) AS has_fn, u.val AS value
        FROM cl2 JOIN pf USING (prompt_id)
        LEFT JOIN molecules mo ON mo.smiles = pf.smiles
        LEFT JOIN vt ON vt.norm = cl2.norm AND vt.task = pf.task
        LEFT JOIN rg ON rg.task = pf.task AND rg.descriptor = vt.descriptor
        LEFT JOIN reg ON reg.key = vt.descriptor
        LEFT JOIN u ON u.smiles = pf.smiles AND u.nm = vt.descriptor AND mo.valid),
det2 AS (SELECT *, CASE WHEN smiles IS NULL THEN 'no_smiles' WHEN NOT valid THEN 'invalid_molecule'
                        WHEN task = 'UNKNOWN_TASK' THEN 'unknown_task' WHEN descriptor IS NULL THEN 'no_match'
                        WHEN NOT has_fn OR lo IS NULL THEN 'no_function_or_range'
                        WHEN value IS NULL THEN 'no_value' ELSE 'scored' END AS claim_status FROM det),
det3 AS (SELECT *, CASE WHEN claim_status = 'scored' THEN (CASE WHEN value BETWEEN lo AND hi THEN 1 ELSE -1 END) END AS range_label
         FROM det2),
det4 AS (SELECT *, abs(label + range_label) / 2.0::DOUBLE AS agreement FROM det3),
pc AS (SELECT prompt_id, gen_idx, count(*) AS n_claims, count(agreement) AS n_scored, avg(agreement) AS adv
       FROM det4 GROUP BY prompt_id, gen_idx),
sc AS (SELECT c.prompt_id, c.gen_idx, pf.task, pf.smiles, coalesce(mo.valid, FALSE) AS valid,
              {R1('c.completion')} AS reward_format,
              CASE WHEN contains({ANSWER('c.completion')}, pf.answer) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS reward_correctness,
              {R3('c.completion')} AS reward_choices,
              coalesce(pc.adv, 0.0::DOUBLE) AS reward_advantage,
              coalesce(pc.n_claims, 0) AS n_claims, coalesce(pc.n_scored, 0) AS n_scored
       FROM completions c JOIN pf USING (prompt_id)
       LEFT JOIN molecules mo ON mo.smiles = pf.smiles
       LEFT JOIN pc ON pc.prompt_id = c.prompt_id AND pc.gen_idx = c.gen_idx),
sc2 AS (SELECT *, reward_format + reward_correctness + reward_choices + reward_advantage AS reward_total,
               CASE WHEN n_claims = 0 THEN 'no_claims' WHEN smiles IS NULL THEN 'no_smiles'
                    WHEN NOT valid THEN 'invalid_molecule' WHEN task = 'UNKNOWN_TASK' THEN 'unknown_task'
                    WHEN n_scored = 0 THEN 'none_scorable' ELSE 'scored' END AS skip_reason FROM sc)
"""


def oracle(key: str, sql: str) -> None:
    ORACLES[key] = sql.strip()


C = duckdb_ctes("completions")
P = duckdb_ctes("prompts")
SCORING = _ctes_scoring()

# ----- S1, P1, P2 ------------------------------------------------------------------------
_JSON = """WITH j AS (SELECT o_orderkey, '[{"instruction":"' || o_orderpriority || '","input":"SMILES M' || CAST(o_orderkey AS VARCHAR)
  || '","output":' || CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END)
                         WHEN o_orderkey % 3 = 1 THEN '"' || o_orderstatus || '"' ELSE 'null' END
  || '},{"instruction":"' || o_orderstatus || '","input":"' || o_orderpriority || '","output":"' || o_orderpriority || '"}]' AS js
  FROM orders),
a AS (SELECT o_orderkey, from_json(js, '[{"instruction":"VARCHAR","input":"VARCHAR","output":"JSON"}]') AS arr FROM j),
e AS (SELECT o_orderkey, unnest(arr) AS r, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS idx FROM a),
f AS (SELECT o_orderkey, idx, r.instruction AS instruction, r.input AS input,
        CASE WHEN r.output IS NULL OR json_type(r.output) = 'NULL' THEN 'None'
             WHEN json_type(r.output) = 'BOOLEAN' THEN CASE WHEN CAST(r.output AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END
             WHEN json_type(r.output) = 'VARCHAR' THEN json_extract_string(r.output, '$')
             ELSE CAST(r.output AS VARCHAR) END AS answer FROM e)
"""
oracle("json_array_records", _JSON + "SELECT o_orderkey, idx, instruction, input, answer FROM f")
oracle("answer_to_string", _JSON + "SELECT o_orderkey, idx, answer FROM f")
oracle("assemble_prompt", f"""
WITH g AS (SELECT conv_id,
   arg_min(text, turn) FILTER (WHERE role = 'system') AS sys,
   arg_min(text, turn) FILTER (WHERE role = 'user') AS usr,
   count(*) AS n_messages FROM conversations GROUP BY conv_id)
SELECT conv_id, n_messages, CAST((sys IS NOT NULL)::INT + (usr IS NOT NULL)::INT AS BIGINT) AS prompt_len,
       CASE WHEN sys IS NULL THEN 'UNKNOWN_TASK' ELSE {TASK('sys')} END AS task,
       CAST(length(usr) AS BIGINT) AS user_chars FROM g""")

# ----- X1-X10 ---------------------------------------------------------------------------------
oracle("extract_answer", C + f"SELECT prompt_id, gen_idx, {ANSWER('completion')} AS answer_text FROM completions")
oracle("extract_answer_greedy", C + f"SELECT prompt_id, gen_idx, {ANSWER('completion', True)} AS answer_text FROM completions")
oracle("extract_name_block", C + f"SELECT prompt_id, gen_idx, {NAME_BLOCK('completion')} AS name_block FROM completions")
oracle("parse_claims", SCORING + "SELECT prompt_id, gen_idx, pos, prop, label FROM cl2")
oracle("claim_status", SCORING + f"""SELECT prompt_id, gen_idx, pos, status, label,
  CAST(CASE WHEN contains(lower(status), 'not improve') THEN -1 WHEN contains(lower(status), 'improve') THEN 1 ELSE -1 END AS BIGINT)
  AS label_negation_aware FROM cl2""")
oracle("claim_filters", SCORING + """SELECT nb.prompt_id, nb.gen_idx,
  CAST((SELECT count(*) FROM it3 WHERE it3.prompt_id = nb.prompt_id AND it3.gen_idx = nb.gen_idx) AS BIGINT) AS n_items,
  CAST((SELECT count(*) FROM cl WHERE cl.prompt_id = nb.prompt_id AND cl.gen_idx = nb.gen_idx) AS BIGINT) AS n_claims
  FROM nb""")
oracle("normalize_name", SCORING + "SELECT DISTINCT prop, norm FROM cl2")
oracle("extract_task", P + f"SELECT prompt_id, {TASK('system_content')} AS task FROM prompts")
oracle("extract_smiles", P + f"SELECT prompt_id, {SMILES('user_content')} AS smiles FROM prompts")
_PART = """WITH pt AS (SELECT p_partkey, p_name, p_brand,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' #### ' || p_brand || ' #### ' || p_type END AS txt,
  chr(10) || ' ' || chr(160) || p_name || chr(9) || chr(28) || chr(8195) AS padded FROM part)
"""
oracle("extract_hash_answer", _PART + f"""SELECT p_partkey,
  CASE WHEN contains(txt, '####') THEN {STRIP("string_split(txt, '####')[2]")} END AS hash_answer FROM pt""")
oracle("format_template", _PART + """SELECT p_partkey, chr(10) || '<name>' || chr(10) || coalesce(p_name, 'None') || chr(10)
  || '</name>' || chr(10) || '<answer>' || chr(10) || coalesce(p_brand, 'None') || chr(10) || '</answer>' || chr(10) AS formatted FROM pt""")
oracle("unicode_strip", _PART + f"SELECT p_partkey, {STRIP('padded')} AS stripped, trim(padded, ' ') AS spark_trimmed FROM pt")

# ----- R1-R3, E1 ---------------------------------------------------------------------------------
oracle("reward_format", C + f"SELECT prompt_id, gen_idx, {R1('completion')} AS reward_format FROM completions")
oracle("reward_correctness", duckdb_ctes("completions", "prompts") + f"""SELECT prompt_id, gen_idx,
  CASE WHEN contains({ANSWER('completion')}, answer) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS reward_correctness,
  CASE WHEN {ANSWER('completion')} = answer THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS reward_exact
  FROM completions JOIN prompts USING (prompt_id)""")
oracle("reward_choice_count", C + f"""SELECT prompt_id, gen_idx, {R3('completion')} AS reward_choices,
  {R3('completion', True)} AS reward_choices_dotall FROM completions""")
oracle("answer_accuracy", duckdb_ctes("completions", "prompts") + f"""SELECT
  round(coalesce(avg(CASE WHEN {STRIP(ANSWER('completion'))} = {STRIP('answer')} THEN 1.0 ELSE 0.0 END::DOUBLE), 0.0), 6) AS accuracy,
  count(*) AS n FROM completions JOIN prompts USING (prompt_id)""")

# ----- joins ---------------------------------------------------------------------------------------
oracle("align_by_key", SCORING + "SELECT c.prompt_id, c.gen_idx, pf.task, pf.smiles, pf.answer FROM completions c JOIN pf USING (prompt_id)")
oracle("invalid_molecules", SCORING + """SELECT prompt_id, smiles FROM pf WHERE smiles IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM molecules m WHERE m.smiles = pf.smiles AND m.valid)""")
oracle("alias_lookup_join", SCORING + f"""SELECT prompt_id, gen_idx, pos, norm AS alias, a.descriptor FROM cl2
  LEFT JOIN ({dims.sql_alias()}) a ON a.alias = cl2.norm""")
oracle("registry_resolve", SCORING + """SELECT prompt_id, gen_idx, pos, norm AS key, reg.descriptor AS canonical, reg.is_function
  FROM cl2 LEFT JOIN reg ON reg.key = cl2.norm""")
oracle("resolve_property", SCORING + "SELECT norm, task, descriptor, stage, matched_key FROM vt WHERE norm IN (SELECT norm FROM cl2)")
oracle("range_lookup_join", SCORING + "SELECT prompt_id, gen_idx, pos, task, descriptor, lo, hi FROM det4")
oracle("in_range_label", SCORING + """SELECT prompt_id, gen_idx, pos, value, lo, hi, CAST(range_label AS BIGINT) AS range_label
  FROM det4 WHERE claim_status = 'scored'""")
oracle("descriptor_join", SCORING + """SELECT d.prompt_id, d.gen_idx, d.pos, d.smiles, d.descriptor, u.val AS value
  FROM det4 d JOIN u ON u.smiles = d.smiles AND u.nm = d.descriptor WHERE d.descriptor IS NOT NULL AND d.valid""")

# ----- rewards -----------------------------------------------------------------------------------------
oracle("advantage_detail", SCORING + """SELECT prompt_id, gen_idx, pos, prop, label, descriptor, value, lo, hi,
  CAST(range_label AS BIGINT) AS range_label, round(agreement, 6) AS agreement FROM det4 WHERE claim_status = 'scored'""")
oracle("skip_unscorable", SCORING + "SELECT prompt_id, gen_idx, pos, claim_status FROM det4")
oracle("reward_advantage", SCORING + "SELECT prompt_id, gen_idx, round(reward_advantage, 6) AS reward_advantage FROM sc2")
oracle("score_guards", SCORING + "SELECT prompt_id, gen_idx, skip_reason, round(reward_advantage, 6) AS reward_advantage FROM sc2")
oracle("reward_total", SCORING + """SELECT prompt_id, gen_idx, task, reward_format, reward_correctness, reward_choices,
  round(reward_advantage, 6) AS reward_advantage, round(reward_total, 6) AS reward_total FROM sc2""")
oracle("group_advantage", SCORING + """, ga AS (SELECT prompt_id, gen_idx, reward_total,
   avg(reward_total) OVER w AS group_mean, stddev_samp(reward_total) OVER w AS group_std FROM sc2
   WINDOW w AS (PARTITION BY prompt_id))
SELECT prompt_id, gen_idx, round(reward_total, 6) AS reward_total, round(group_mean, 6) AS group_mean,
  round(group_std, 6) AS group_std,
  round((reward_total - group_mean) / (coalesce(group_std, 0.0) + 1e-4), 6) AS advantage FROM ga""")
oracle("batch_task", P + f""", p AS (SELECT prompt_id, CAST(floor(prompt_id / 4) AS BIGINT) AS batch_id, {TASK('system_content')} AS task FROM prompts),
b AS (SELECT batch_id, arg_min(task, prompt_id) AS batch_task FROM p GROUP BY batch_id)
SELECT prompt_id, batch_id, task, batch_task FROM p JOIN b USING (batch_id)""")
oracle("reward_summary", SCORING + """, lg AS (UNPIVOT (SELECT task, reward_format, reward_correctness, reward_choices,
    reward_advantage, reward_total FROM sc2) ON reward_format, reward_correctness, reward_choices, reward_advantage, reward_total
    INTO NAME reward VALUE value)
SELECT reward, task, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max FROM lg GROUP BY ROLLUP (reward, task)""")

# ----- evaluation -------------------------------------------------------------------------------------
EV = """WITH t AS (SELECT doc_id, n_chars::DOUBLE AS score, quality AS label, lang, source
                FROM labels JOIN documents USING (doc_id))"""


def _roc(group: str) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f""",
q AS (SELECT {g}score AS threshold, CAST(sum(label) AS BIGINT) AS tp_s, CAST(sum(1 - label) AS BIGINT) AS fp_s
      FROM t GROUP BY ALL),
k AS (SELECT {g}threshold, tp_s, fp_s,
             CAST(sum(tp_s) OVER ({part}ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
             CAST(sum(fp_s) OVER ({part}ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM q),
tot AS (SELECT {g}CAST(sum(label) AS BIGINT) AS P, CAST(sum(1 - label) AS BIGINT) AS N FROM t {'GROUP BY ' + group if group else ''})
"""


_YOUDEN = """, yt AS (SELECT CASE WHEN max(tp * N - fp * P) > 0 THEN arg_max(threshold, (tp * N - fp * P, threshold))
                   ELSE 'inf'::DOUBLE END AS threshold,
              greatest(max(tp * N - fp * P), 0) AS gain FROM k CROSS JOIN tot)
"""
_PRED = _YOUDEN + """, pr AS (SELECT t.*, CAST(score >= yt.threshold AS BIGINT) AS pred, yt.threshold FROM t CROSS JOIN yt)
"""

oracle("roc_auc", EV + _roc("") + """SELECT round(CAST(sum(fp_s * (2 * (tp - tp_s) + tp_s)) AS DOUBLE) / (2.0 * P * N), 6) AS auc,
  P AS n_pos, N AS n_neg FROM k CROSS JOIN tot GROUP BY P, N""")
oracle("roc_curve", EV + _roc("") + """SELECT threshold, tp, fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM k CROSS JOIN tot
  UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""")
oracle("roc_curve_reduced", EV.replace("n_chars::DOUBLE AS score", "floor(n_chars / 50.0) * 50 AS score") + _roc("") + """,
nx AS (SELECT *, lead(tp_s) OVER o AS tp_n, lead(fp_s) OVER o AS fp_n, row_number() OVER o AS i FROM k WINDOW o AS (ORDER BY threshold DESC))
SELECT threshold, tp, fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM nx CROSS JOIN tot
WHERE i = 1 OR tp_n IS NULL OR tp_n <> tp_s OR fp_n <> fp_s
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""")
oracle("youden_threshold", EV + _roc("") + _YOUDEN + "SELECT threshold, gain FROM yt")
oracle("apply_threshold", EV + _roc("") + _PRED + "SELECT doc_id, score, CAST(label AS BIGINT) AS label, pred FROM pr")
oracle("accuracy", EV + _roc("") + _PRED + """SELECT any_value(threshold) AS threshold,
  round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM pr""")
oracle("confusion_counts", EV + _roc("") + _PRED + """, cls AS (SELECT DISTINCT CAST(label AS BIGINT) AS c FROM pr UNION SELECT DISTINCT pred FROM pr),
cc AS (SELECT c AS label,
  count(*) FILTER (WHERE label = c AND pred = c) AS tp,
  count(*) FILTER (WHERE label <> c AND pred = c) AS fp,
  count(*) FILTER (WHERE label = c AND pred <> c) AS fn FROM pr CROSS JOIN cls GROUP BY c)
SELECT label, tp, fp, fn, tp + fn AS support,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM cc""")
oracle("roc_auc_by_group", EV + _roc("lang") + """SELECT lang,
  round(CASE WHEN P > 0 AND N > 0 THEN CAST(sum(fp_s * (2 * (tp - tp_s) + tp_s)) AS DOUBLE) / (2.0 * P * N) END, 6) AS auc,
  P AS n_pos, N AS n_neg FROM k JOIN tot USING (lang) GROUP BY lang, P, N""")
oracle("cv_best", EV + _roc("source, lang").replace("USING (lang)", "") + """, a AS (SELECT source, lang,
  CASE WHEN P > 0 AND N > 0 THEN CAST(sum(fp_s * (2 * (tp - tp_s) + tp_s)) AS DOUBLE) / (2.0 * P * N) END AS auc
  FROM k JOIN tot USING (source, lang) GROUP BY source, lang, P, N),
m AS (SELECT source AS param, avg(auc) AS mean_score FROM a GROUP BY source)
SELECT arg_min(param, (-mean_score, param)) AS param, round(max(mean_score), 6) AS mean_score, count(*) AS n_settings FROM m WHERE mean_score IS NOT NULL""")

_FOLDS = """WITH l AS (SELECT doc_id, CAST(quality AS BIGINT) AS label FROM labels),
cls AS (SELECT label, min(doc_id) AS first FROM l GROUP BY label),
cr AS (SELECT label, row_number() OVER (ORDER BY first) AS crank FROM cls),
s AS (SELECT doc_id, l.label, row_number() OVER (ORDER BY crank, doc_id) - 1 AS j,
             row_number() OVER (PARTITION BY l.label ORDER BY doc_id) - 1 AS r FROM l JOIN cr USING (label)),
f AS (SELECT label, j % 5 AS fold, row_number() OVER (PARTITION BY label ORDER BY j % 5, j) - 1 AS r FROM s),
fo AS (SELECT doc_id, label, CAST(fold AS BIGINT) AS fold FROM s JOIN f USING (label, r))
"""
oracle("stratified_folds", _FOLDS + "SELECT doc_id, label, fold FROM fo")
oracle("concat_train_valid", _FOLDS + """SELECT doc_id, label, 'train' AS split FROM fo WHERE fold >= 2
  UNION ALL SELECT doc_id, label, 'valid' AS split FROM fo WHERE fold = 1""")
oracle("balanced_weights", """WITH l AS (SELECT doc_id, CAST(quality AS BIGINT) AS label FROM labels),
c AS (SELECT label, count(*) AS n_c FROM l GROUP BY label),
w AS (SELECT label, (SELECT count(*) FROM l) / ((SELECT count(*) FROM c) * n_c) AS weight FROM c)
SELECT doc_id, label, round(weight, 6) AS weight FROM l JOIN w USING (label)""")
oracle("cast_label", """WITH t AS (SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN CASE WHEN quality = 1 THEN 'True' ELSE 'False' END
    WHEN 1 THEN CASE WHEN quality = 1 THEN '1.0' ELSE '0.0' END
    ELSE CASE WHEN quality = 1 THEN '1' ELSE '0' END END AS label_text FROM labels)
SELECT doc_id, label_text, CAST(coalesce(CAST(TRY_CAST(label_text AS BOOLEAN) AS INT), CAST(TRY_CAST(label_text AS DOUBLE) AS INT)) AS BIGINT) AS label FROM t""")
oracle("select_features", """SELECT doc_id, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words,
  len(string_split(text, chr(10)))::DOUBLE AS n_lines FROM documents""")

# ----- streaming batch twin ------------------------------------------------------------------------
oracle("reward_metrics_windowed", """WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, event_type AS task, value FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  task, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max FROM b GROUP BY ws, task""")

# ----- SMOTE (brute-force neighbours are fine in the oracle) ---------------------------------------
oracle("smote_oversample", """WITH d AS (SELECT l.doc_id, CAST(l.quality AS BIGINT) AS label, d.n_chars::DOUBLE AS n_chars,
    len(string_split(d.text, ' '))::DOUBLE AS n_words, len(string_split(d.text, chr(10)))::DOUBLE AS n_lines
  FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT label, count(*) AS n FROM d GROUP BY label),
mi AS (SELECT arg_min(label, (n, label)) AS label, min(n) AS n_min, max(n) AS n_maj FROM c),
m AS (SELECT d.*, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM d JOIN mi USING (label)),
nn AS (SELECT a.doc_id AS base_id, b.doc_id AS nn_id,
         row_number() OVER (PARTITION BY a.doc_id ORDER BY (a.n_chars - b.n_chars)^2 + (a.n_words - b.n_words)^2
                            + (a.n_lines - b.n_lines)^2, b.doc_id) AS nn_rank
       FROM m a JOIN m b ON a.doc_id <> b.doc_id),
dr AS (SELECT i, ('0x' || substr(md5('196:' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % (n_min * 5) AS s,
              ('0x' || substr(md5('196:' || CAST(i AS VARCHAR)), 9, 8))::BIGINT / 4294967296.0 AS gap
       FROM mi, range(0, n_maj - n_min) AS r(i)),
g AS (SELECT i, gap, s // 5 AS base_idx, s % 5 + 1 AS nn_rank FROM dr)
SELECT g.i, b.doc_id AS base_id, nn.nn_id, round(g.gap, 6) AS gap,
  round(b.n_chars + g.gap * (o.n_chars - b.n_chars), 6) AS n_chars,
  round(b.n_words + g.gap * (o.n_words - b.n_words), 6) AS n_words,
  round(b.n_lines + g.gap * (o.n_lines - b.n_lines), 6) AS n_lines, b.label
FROM g JOIN m b ON b.idx = g.base_idx JOIN nn ON nn.base_id = b.doc_id AND nn.nn_rank = g.nn_rank
JOIN m o ON o.doc_id = nn.nn_id""")

# ----- sources / sinks / reward surface / stream -------------------------------------------------------
oracle("csv_scan", """SELECT l.doc_id, d.n_chars::DOUBLE AS n_chars, len(string_split(d.text, ' '))::DOUBLE AS n_words,
  len(string_split(d.text, chr(10)))::DOUBLE AS n_lines, CAST(l.quality AS BIGINT) AS label
  FROM labels l JOIN documents d USING (doc_id)""")
oracle("metrics_sink", ORACLES["roc_curve"])
oracle("metrics_sink_runs", EV + """, m AS (SELECT CAST(label AS VARCHAR) AS split, count(*)::DOUBLE AS n, round(avg(score), 6) AS s FROM t GROUP BY label),
r AS (SELECT 'a' AS run, 0 AS rows_more, 1 AS score_more UNION ALL SELECT 'b', 0, 0)
SELECT run, split, 'rows' AS metric, n + rows_more AS value FROM m, r
UNION ALL SELECT run, split, 'mean_score', round(s + score_more, 6) FROM m, r""")
oracle("json_array_split", """SELECT 'doc ' || doc_id AS instruction, md5(coalesce(text, '')) AS input_md5,
  CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS answer FROM documents JOIN labels USING (doc_id)""")
oracle("reward_registry", SCORING + """SELECT prompt_id, gen_idx, reward_format, reward_correctness, reward_choices,
  round(reward_advantage, 6) AS reward_advantage, CASE WHEN skip_reason = 'no_claims' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  AS reward_answered, round(reward_total, 6) AS reward_total FROM sc2""")
oracle("stream_score", SCORING + """SELECT prompt_id, gen_idx, reward_format, reward_correctness, reward_choices,
  round(reward_advantage, 6) AS reward_advantage, round(reward_total, 6) AS reward_total, skip_reason FROM sc2""")
oracle("stream_group_advantage", """WITH g AS (SELECT event_id // 8 AS prompt_id, event_id % 8 AS gen_idx, value AS r FROM events),
s AS (SELECT *, avg(r) OVER w AS m, stddev_samp(r) OVER w AS d, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY prompt_id))
SELECT prompt_id, gen_idx, round(r, 6) AS reward_total, round(m, 6) AS group_mean, n AS group_size,
  round((r - m) / (coalesce(d, 0) + 0.0001), 6) AS advantage, TRUE AS whole FROM s""")
# complete: every window of the batch twin
oracle("stream_reward_metrics", ORACLES["reward_metrics_windowed"])

# ----- similarity of the frozen names ----------------------------------------------------------------------
_RATIOS = f"fr AS (SELECT norm, key, CAST(ratio AS DOUBLE) AS ratio, CAST(used AS DOUBLE) AS used FROM {_vals(FROZEN_RATIOS, ['norm', 'key', 'ratio', 'used'])})"
oracle("fuzzy_top1_join", SCORING.rstrip() + f""", {_RATIOS}
SELECT norm, key, ratio FROM fr WHERE norm IN (SELECT norm FROM cl2)""")
oracle("match_trace", SCORING.rstrip() + f""", {_RATIOS}
SELECT n.name, n.norm, vt.task, vt.descriptor, vt.stage, vt.matched_key, fr.used AS ratio
FROM (SELECT DISTINCT prop AS name, norm FROM cl2) n JOIN vt USING (norm) JOIN fr USING (norm)""")

# ----- learning: what any right fit must return ------------------------------------------------------------
_LEARN = _FOLDS + """, li AS (SELECT fo.doc_id, fo.label, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split
  FROM fo JOIN documents USING (doc_id))
"""
# Rows of the learners: features as a list; the exact learners fit on train and validation rows.
_ROWS = _LEARN + """, ft AS MATERIALIZED (SELECT li.doc_id, CAST(li.label AS BIGINT) AS label, split, [d.n_chars::DOUBLE,
    len(string_split(d.text, ' '))::DOUBLE, len(string_split(d.text, chr(10)))::DOUBLE] AS x FROM li JOIN documents d USING (doc_id))
"""


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8))::BIGINT"


def _grow(depth: int, n_features: int, weights: tuple[str, str], per_node: int = 0, seed: int = 0, min_leaf: int = 1) -> str:
    """Level-wise growth over g0(tree, node, c0, c1, x): nodes of level i are n<i>."""
    out = []
    side = lambda a, b: (f"(CASE WHEN {a} * {weights[0]} + {b} * {weights[1]} > 0 THEN ({a} * {weights[0]})::DOUBLE * ({b} * {weights[1]})"  # noqa: E731
                         f"::DOUBLE / ({a} * {weights[0]} + {b} * {weights[1]})::DOUBLE ELSE 0.0::DOUBLE END)")
    prob = f"(c1 * {weights[1]})::DOUBLE / (c0 * {weights[0]} + c1 * {weights[1]})::DOUBLE"
    for i in range(depth + 1):
        out.append(f"t{i} AS MATERIALIZED (SELECT tree, node, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1 FROM g{i} GROUP BY tree, node)")
        if i == depth:
            out.append(f"n{i} AS (SELECT tree, node, {i} AS depth, c0, c1, NULL::INTEGER AS feature, NULL::DOUBLE AS threshold, "
                       f"NULL::DOUBLE AS gain, {prob} AS prob FROM t{i})")
            break
        out.append(f"""v{i} AS (SELECT tree, node, feature, value, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1
  FROM (SELECT tree, node, c0, c1, unnest(range(0, {n_features})) AS feature, unnest(x) AS value FROM g{i}) GROUP BY ALL),
p{i} AS (SELECT tree, node, feature, value, sum(c0) OVER r::BIGINT AS l0, sum(c1) OVER r::BIGINT AS l1, sum(c0) OVER k::BIGINT AS n0,
    sum(c1) OVER k::BIGINT AS n1, lead(value) OVER o AS nxt FROM v{i}
  WINDOW k AS (PARTITION BY tree, node, feature), o AS (PARTITION BY tree, node, feature ORDER BY value),
    r AS (PARTITION BY tree, node, feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
s{i} AS (SELECT *, {side('l0', 'l1')} + {side('(n0 - l0)', '(n1 - l1)')} AS rest FROM p{i}
  WHERE nxt IS NOT NULL AND n0 > 0 AND n1 > 0 AND l0 + l1 >= {min_leaf} AND n0 + n1 - l0 - l1 >= {min_leaf}),
f{i} AS (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY tree, node, feature ORDER BY rest, value) = 1),
d{i} AS (SELECT * FROM f{i} {f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_draw(f"'{seed}'", 'tree', 'node', 'feature')}, feature) <= {per_node}" if per_node else ""}),
b{i} AS MATERIALIZED (SELECT tree, node, feature::INTEGER AS feature,
    CASE WHEN (value + nxt) / 2 < nxt THEN (value + nxt) / 2 ELSE value END AS threshold, {side('n0', 'n1')} - rest AS gain
  FROM d{i} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY rest, feature) = 1),
n{i} AS (SELECT tree, node, {i} AS depth, c0, c1, feature, threshold, gain, {prob} AS prob FROM t{i} LEFT JOIN b{i} USING (tree, node)),
g{i + 1} AS MATERIALIZED (SELECT tree, node * 2 + CASE WHEN x[feature + 1] > threshold THEN 1 ELSE 0 END AS node, c0, c1, x
  FROM g{i} JOIN b{i} USING (tree, node))""")
    return ",\n".join(out)


_FOREST = dict(trees=100, depth=10)
_TIMES = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in poisson_cuts())
_FOREST_NODES = _ROWS + f""", u0 AS (SELECT doc_id, label, x, tree, {_draw("'196'", 'tree', 'doc_id')} AS u
  FROM ft, range(0, {_FOREST['trees']}) AS r(tree) WHERE split <> 'test'),
u1 AS (SELECT *, {_TIMES} AS times FROM u0),
g0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, times * (1 - label) AS c0, times * label AS c1, x FROM u1 WHERE times > 0),
""" + _grow(_FOREST["depth"], 3, ("1", "1"), per_node=1, seed=196)
_ALL_NODES = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(_FOREST["depth"] + 1))
# every row walks down every tree, level by level
_WALK = ", w0 AS (SELECT doc_id, x, tree, 1::BIGINT AS node FROM ft, range(0, {t}) AS r(tree))".format(t=_FOREST["trees"]) + "".join(
    f""", w{i + 1} AS MATERIALIZED (SELECT doc_id, x, tree, CASE WHEN b{i}.feature IS NULL THEN node
    WHEN x[b{i}.feature + 1] > b{i}.threshold THEN node * 2 + 1 ELSE node * 2 END AS node FROM w{i} LEFT JOIN b{i} USING (tree, node))"""
    for i in range(_FOREST["depth"]))
oracle("rf_fit_score", _FOREST_NODES + _WALK + f""", an AS ({_ALL_NODES})
SELECT ft.doc_id, ft.split, ft.label, round(avg(an.prob), 6) AS prob
FROM w{_FOREST['depth']} w JOIN an USING (tree, node) JOIN ft ON ft.doc_id = w.doc_id GROUP BY ALL""")
oracle("importance_rank", _FOREST_NODES + f""", an AS ({_ALL_NODES}),
pt AS (SELECT tree, feature, sum(gain) AS g FROM an WHERE feature IS NOT NULL GROUP BY tree, feature),
tt AS (SELECT tree, sum(g) AS t FROM pt GROUP BY tree HAVING sum(g) > 0),
sh AS (SELECT feature, sum(g / t) AS s FROM pt JOIN tt USING (tree) GROUP BY feature),
im AS (SELECT i, ['n_chars', 'n_words', 'n_lines'][i + 1] AS feature, coalesce(s / (SELECT sum(s) FROM sh), 0.0) AS importance
  FROM range(0, 3) AS r(i) LEFT JOIN sh ON sh.feature = i)
SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, i) AS INTEGER) AS rank FROM im""")
oracle("model_save_load", _LEARN + "SELECT doc_id, split, TRUE AS same_after_load FROM li")
oracle("balanced_tree", _ROWS + """, cw AS (SELECT sum(label)::BIGINT // gcd(sum(label)::BIGINT, count(*) - sum(label)::BIGINT) AS a0,
    (count(*) - sum(label)::BIGINT) // gcd(sum(label)::BIGINT, count(*) - sum(label)::BIGINT) AS a1 FROM ft WHERE split <> 'test'),
g0 AS MATERIALIZED (SELECT 0 AS tree, 1::BIGINT AS node, 1 - label AS c0, label AS c1, x FROM ft WHERE split <> 'test'),
""" + _grow(4, 3, ("(SELECT a0 FROM cw)", "(SELECT a1 FROM cw)")) + """
SELECT node, depth, c0, c1, ['n_chars', 'n_words', 'n_lines'][feature + 1] AS feature, round(threshold, 6) AS threshold,
  round(gain, 6) AS gain, round(prob, 6) AS prob FROM (""" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(5)) + ")")
oracle("grid_search_cv", _LEARN + """, g AS (
  SELECT n, d, l FROM (VALUES (100), (120), (140), (160), (180), (200)) AS a(n),
    (VALUES (10), (12), (14), (16), (18), (20)) AS b(d), (VALUES (1), (2)) AS c(l)),
s2 AS (SELECT count(*) AS n_rows, sum(label) AS n_pos FROM li WHERE split <> 'test')
SELECT row_number() OVER (ORDER BY n, d, l) - 1 AS param_id, n AS "numTrees", d AS "maxDepth", l AS "minInstancesPerNode",
  5 AS n_folds, n_rows, CAST(n_pos AS BIGINT) AS n_pos, TRUE AS auc_in_range, TRUE AS winner_is_best FROM g, s2""")
oracle("tune_and_apply", _LEARN + """, c AS (SELECT split, count(*) AS n FROM li GROUP BY split)
SELECT split, metric, n, TRUE AS holds FROM c, (VALUES ('accuracy'), ('auc')) AS m(metric) WHERE split <> 'train'
UNION ALL SELECT 'test', 'roc_ends_at_all_rows', n, TRUE FROM c WHERE split = 'test'
UNION ALL SELECT 'cv', 'best_auc_in_range', n, TRUE FROM c WHERE split = 'valid'""")
