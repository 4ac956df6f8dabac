"""Independent DuckDB statements for the registered queries.

Tables documents, embeddings, labels, events, ... are pre-registered views.
"""

from __future__ import annotations

from bagwise.plans import params as P

U52 = "4503599627370496"   # 2^52


def u(expr: str) -> str:
    """uniform [0,1) from the md5 of ``expr``."""
    return f"(CAST(('0x' || substr(md5({expr}), 1, 13)) AS BIGINT) / CAST({U52} AS DOUBLE))"


def pad(e: str, d: int) -> str:
    return f"(CASE WHEN length(CAST({e} AS VARCHAR)) >= {d} THEN CAST({e} AS VARCHAR) " \
           f"ELSE lpad(CAST({e} AS VARCHAR), {d}, '0') END)"


RECORDS = """
r0 AS (
  SELECT doc_id AS id, upper(substr(lang, 1, 1)) AS digit_1,
         CAST(substr(source, 4) AS INTEGER) % 5 AS digit_2, lang, n_chars,
         string_split(text, chr(10)) AS parts
  FROM documents),
records AS (
  SELECT id, digit_1, digit_2,
         CAST(CASE WHEN lang <> 'en' THEN n_chars % 100 // 10
                   WHEN digit_2 >= 3 AND n_chars < 800 THEN 101 ELSE 102 END AS BIGINT) AS digit_3,
         parts[1] AS text_obj, parts[2] AS text_mthd,
         CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:], chr(10)) END AS text_deal
  FROM r0)"""

FILLED = """
filled AS (
  SELECT id, digit_1, digit_2, digit_3, coalesce(text_obj, '') AS text_obj,
         coalesce(text_mthd, '') AS text_mthd, coalesce(text_deal, '') AS text_deal
  FROM records)"""

LABELLED = RECORDS + "," + FILLED + f""",
dedup AS (
  SELECT min(id) AS id, digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal
  FROM filled GROUP BY digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal),
coded AS (
  SELECT *, digit_1 || {pad('digit_2', 2)} || {pad('digit_3', 3)} AS digit FROM dedup),
dim AS (
  SELECT CAST(row_number() OVER (ORDER BY digit) - 1 AS INTEGER) AS label, digit
  FROM (SELECT DISTINCT digit FROM coded)),
lab AS (
  SELECT c.id, c.digit_1, c.digit_2, c.digit_3, c.text_obj, c.text_mthd, c.text_deal,
         c.digit, d.label
  FROM coded c JOIN dim d ON c.digit = d.digit)"""


def test_k(n: str, ratio: str) -> str:
    return f"""CAST(CASE WHEN {n} < 3 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 10 THEN 2
            WHEN {n} < 100 THEN floor(CAST(8 AS DOUBLE) / 90 * {n} + CAST(10 AS DOUBLE) / 9)
            ELSE floor({n} * {ratio}) END AS BIGINT)"""


def split_from(labelled: str) -> str:
    return labelled + f""",
hist AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
kk AS (SELECT label, {test_k('n', f'(CAST({P.NUM_TEST} AS DOUBLE) / (SELECT sum(n) FROM hist))')} AS k
       FROM hist),
split AS (
  SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.label
                   ORDER BY md5('{P.SPLIT_SEED}:split:' || l.id), l.id) <= kk.k
              THEN 'test' ELSE 'train' END AS split
  FROM lab l JOIN kk ON l.label = kk.label),
train AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'train'),
test AS (SELECT * EXCLUDE (split) FROM split WHERE split = 'test')"""


SPLIT = split_from(LABELLED)

# bagging flow: code -> dedup on code + texts (null differs from '') -> fill -> label
LABELLED_BAGGING = RECORDS + f""",
coded0 AS (
  SELECT *, digit_1 || {pad('digit_2', 2)} || {pad('digit_3', 3)} AS digit FROM records),
dedup0 AS (
  SELECT min(id) AS id, digit, text_obj, text_mthd, text_deal
  FROM coded0 GROUP BY digit, text_obj, text_mthd, text_deal),
coded AS (
  SELECT d.id, c.digit_1, c.digit_2, c.digit_3, coalesce(d.text_obj, '') AS text_obj,
         coalesce(d.text_mthd, '') AS text_mthd, coalesce(d.text_deal, '') AS text_deal,
         d.digit
  FROM dedup0 d JOIN coded0 c ON c.id = d.id),
dim AS (
  SELECT CAST(row_number() OVER (ORDER BY digit) - 1 AS INTEGER) AS label, digit
  FROM (SELECT DISTINCT digit FROM coded)),
lab AS (
  SELECT c.*, d.label FROM coded c JOIN dim d ON c.digit = d.digit)"""


def bags_cte(formula: str = "same", seed: int = P.BAG_SEED, m: int = P.MIN_CAT,
             k_bags: int = P.ESTIMATORS, base: str | None = None
             ) -> str:
    if formula == "same":
        size = f"floor(e * n + ({m} - {m} * e))"
    else:
        size = f"floor((100 * e - {m}) / (100 - {m}) * n + 100 * {m} * (1 - e) / (100 - {m}))"
    return (base or SPLIT) + f""",
bhist AS (SELECT label, count(*) AS n FROM train GROUP BY label),
be AS (SELECT CAST(sum(n) // {P.BAG_DIVISOR} AS DOUBLE) / sum(n) AS e FROM bhist),
bk AS (SELECT label, CAST(CASE WHEN n <= {m} THEN n ELSE {size} END AS BIGINT) AS k
       FROM bhist, be),
pairs AS (SELECT CAST(b.range AS INTEGER) AS bag_id, t.* FROM train t, range({k_bags}) b),
bags AS (
  SELECT p.* EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY bag_id, label
              ORDER BY md5('{seed}:bag:' || bag_id || ':' || id), id) AS rk
    FROM pairs) p JOIN bk ON p.label = bk.label
  WHERE p.rk <= bk.k)"""


ORACLE: dict[str, str] = {}

ORACLE["records_normalise"] = f"WITH {LABELLED} " \
    "SELECT id, digit, label, text_obj || ' ' || text_mthd || ' ' || text_deal AS text FROM lab"

ORACLE["records_clean_hook"] = (
    "WITH " + RECORDS + """,
cleaned AS (
  SELECT id, digit_1, digit_2, digit_3,
         trim(regexp_replace(text_obj, '\\s+', ' ', 'g')) AS text_obj,
         trim(regexp_replace(text_mthd, '\\s+', ' ', 'g')) AS text_mthd,
         trim(regexp_replace(text_deal, '\\s+', ' ', 'g')) AS text_deal
  FROM records)""" + LABELLED.split("records AS (")[1].split("FROM r0)", 1)[1]
    .replace("FROM records)", "FROM cleaned)") +
    " SELECT id, label, text_obj, text_mthd, text_deal FROM lab")

ORACLE["dedup_first6"] = f"WITH {RECORDS}, {FILLED} " + """
SELECT min(id) AS id, digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal
FROM filled GROUP BY digit_1, digit_2, digit_3, text_obj, text_mthd, text_deal"""

ORACLE["dedup_code4"] = f"WITH {RECORDS}, " + f"""
coded AS (SELECT *, digit_1 || {pad('digit_2', 2)} || {pad('digit_3', 3)} AS digit FROM records)
SELECT min(id) AS id, digit, text_obj, text_mthd, text_deal
FROM coded GROUP BY digit, text_obj, text_mthd, text_deal"""

ORACLE["label_dim"] = f"WITH {LABELLED} SELECT label, digit FROM dim"
ORACLE["label_encode"] = f"WITH {LABELLED} SELECT id, label FROM lab"
ORACLE["code_split"] = f"WITH {LABELLED} " + """
SELECT label, digit, substr(digit, 1, 1) AS digit_1, substr(digit, 2, 2) AS digit_2,
       substr(digit, 4) AS digit_3 FROM dim"""

ORACLE["null_patterns"] = f"WITH {RECORDS} " + """
SELECT text_obj IS NULL AS text_obj_null, text_mthd IS NULL AS text_mthd_null,
       text_deal IS NULL AS text_deal_null, count(*) AS n
FROM records GROUP BY ALL"""

ORACLE["column_profile"] = f"WITH {RECORDS} " + """
SELECT col AS "column", non_null FROM (
  SELECT 'id' AS col, count(id) AS non_null FROM records UNION ALL
  SELECT 'digit_1', count(digit_1) FROM records UNION ALL
  SELECT 'digit_2', count(digit_2) FROM records UNION ALL
  SELECT 'digit_3', count(digit_3) FROM records UNION ALL
  SELECT 'text_obj', count(text_obj) FROM records UNION ALL
  SELECT 'text_mthd', count(text_mthd) FROM records UNION ALL
  SELECT 'text_deal', count(text_deal) FROM records)"""

ORACLE["class_histogram"] = f"WITH {LABELLED} SELECT label, count(*) AS n FROM lab GROUP BY label"

ORACLE["class_size_quantiles"] = f"WITH {LABELLED}, " + """
h AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT count(*) AS classes, avg(n) AS mean, quantile_cont(n, 0.0) AS min,
       quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median,
       quantile_cont(n, 0.75) AS q75, quantile_cont(n, 1.0) AS max FROM h"""

ORACLE["split_stratified"] = f"WITH {SPLIT} SELECT id, label, split FROM split"
ORACLE["split_counts"] = f"WITH {SPLIT} " + \
    "SELECT split, count(*) AS rows, count(DISTINCT label) AS classes FROM split GROUP BY split"

ORACLE["bag_same"] = f"WITH {bags_cte('same')} SELECT bag_id, id, label FROM bags"
ORACLE["bag_same_nb"] = f"WITH {bags_cte('nb')} SELECT bag_id, id, label FROM bags"
ORACLE["bag_stats"] = f"WITH {bags_cte('same')} " + \
    "SELECT bag_id, count(*) AS rows, count(DISTINCT label) AS classes FROM bags GROUP BY bag_id"

ORACLE["oob_rows"] = f"WITH {bags_cte('same')} " + """
SELECT id, label, text_obj, text_mthd, text_deal FROM (
  SELECT id, label, text_obj, text_mthd, text_deal FROM train
  UNION ALL
  SELECT DISTINCT id, label, text_obj, text_mthd, text_deal FROM bags)
GROUP BY ALL HAVING count(*) = 1"""

ORACLE["oob_ids"] = f"WITH {bags_cte('same')} " + """
SELECT id, label, text_obj, text_mthd, text_deal FROM train
WHERE id NOT IN (SELECT id FROM bags)"""

ORACLE["test_plus_oob"] = f"WITH {bags_cte('same')} " + """
SELECT id, label, text_obj, text_mthd, text_deal, 'test' AS source FROM test
UNION ALL
SELECT id, label, text_obj, text_mthd, text_deal, 'oob' AS source FROM train
WHERE id NOT IN (SELECT id FROM bags)"""

NONEMPTY = "(length(text_obj) > 0 OR length(text_mthd) > 0 OR length(text_deal) > 0)"

UP_BASE = SPLIT + f""",
uh AS (SELECT label, count(*) AS n, CAST(sum(CAST({NONEMPTY} AS INTEGER)) AS BIGINT) AS n_ok
       FROM train GROUP BY label HAVING count(*) < {P.UP_MIN}),
orig AS (SELECT label, id, text_obj, text_mthd, text_deal, 0 AS draw FROM train)"""

ORACLE["upsample_uniform"] = f"WITH {UP_BASE}, " + f"""
small AS (SELECT t.label, t.id, t.text_obj, t.text_mthd, t.text_deal, uh.n, uh.n_ok,
                 {P.UP_MIN} // uh.n AS reps, {P.UP_MIN} % uh.n AS rem, {NONEMPTY} AS ok
          FROM train t JOIN uh ON t.label = uh.label),
copies AS (
  SELECT label, id, text_obj, text_mthd, text_deal,
         row_number() OVER (PARTITION BY label ORDER BY id, c) AS draw
  FROM (SELECT s.*, unnest(generate_series(2, reps)) AS c FROM small s)),
okr AS (
  SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY md5('{P.UP_SEED}:uniform:' || label || ':' || id), id) AS rk
  FROM small WHERE ok),
extra AS (
  SELECT label, id, text_obj, text_mthd, text_deal, (reps - 1) * n + j AS draw
  FROM (SELECT o.*, unnest(generate_series(rk, rem, n_ok)) AS j FROM okr o))
SELECT label, id, text_obj, text_mthd, text_deal, draw FROM orig
UNION ALL SELECT label, id, text_obj, text_mthd, text_deal, draw FROM copies
UNION ALL SELECT label, id, text_obj, text_mthd, text_deal, draw FROM extra"""

ORACLE["upsample_random"] = f"WITH {UP_BASE}, " + f"""
okr AS (
  SELECT t.label, t.id, t.text_obj, t.text_mthd, t.text_deal,
         row_number() OVER (PARTITION BY t.label ORDER BY t.id) AS rk
  FROM train t JOIN uh ON t.label = uh.label WHERE {NONEMPTY.replace('text_', 't.text_')}),
draws AS (
  SELECT label, j AS draw,
         CAST(floor({u(f"'{P.UP_SEED}:random:' || label || ':' || j")} * n_ok) + 1 AS BIGINT) AS rk
  FROM (SELECT uh.*, unnest(generate_series(1, {P.UP_MIN} - n)) AS j FROM uh))
SELECT label, id, text_obj, text_mthd, text_deal, draw FROM orig
UNION ALL
SELECT d.label, o.id, o.text_obj, o.text_mthd, o.text_deal, d.draw
FROM draws d JOIN okr o ON d.label = o.label AND d.rk = o.rk"""

ORACLE["upsample_shuffle"] = f"WITH {UP_BASE}, " + f"""
cr AS (
  SELECT t.label, t.text_obj, t.text_mthd, t.text_deal,
         row_number() OVER (PARTITION BY t.label ORDER BY t.id) AS rk
  FROM train t JOIN uh ON t.label = uh.label),
cand AS (
  SELECT label, j, n, {P.UP_MIN} - n AS d,
    CAST(floor({u(f"'{P.UP_SEED}:shuffle:text_obj:' || label || ':' || j")} * n) + 1 AS BIGINT) AS i1,
    CAST(floor({u(f"'{P.UP_SEED}:shuffle:text_mthd:' || label || ':' || j")} * n) + 1 AS BIGINT) AS i2,
    CAST(floor({u(f"'{P.UP_SEED}:shuffle:text_deal:' || label || ':' || j")} * n) + 1 AS BIGINT) AS i3
  FROM (SELECT uh.*, unnest(generate_series(1, 3 * (({P.UP_MIN} - n) * 4 + 16))) AS j FROM uh)),
filled_c AS (
  SELECT c.label, c.j, c.d, a.text_obj, b.text_mthd, e.text_deal
  FROM cand c
  JOIN cr a ON a.label = c.label AND a.rk = c.i1
  JOIN cr b ON b.label = c.label AND b.rk = c.i2
  JOIN cr e ON e.label = c.label AND e.rk = c.i3
  WHERE {NONEMPTY.replace('text_obj', 'a.text_obj').replace('text_mthd', 'b.text_mthd').replace('text_deal', 'e.text_deal')}),
acc AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY j) AS draw FROM filled_c)
SELECT label, id, text_obj, text_mthd, text_deal, draw FROM orig
UNION ALL
SELECT label, CAST(NULL AS BIGINT) AS id, text_obj, text_mthd, text_deal, draw
FROM acc WHERE draw <= d"""

TEXT = "text_obj || ' ' || text_mthd || ' ' || text_deal"

ORACLE["preprocess_pipeline"] = "WITH " + split_from(LABELLED) + f""",
uh AS (SELECT label, count(*) AS n,
              CAST(sum(CAST({NONEMPTY} AS INTEGER)) AS BIGINT) AS n_ok
       FROM train GROUP BY label HAVING count(*) < {P.UP_MIN}),
small AS (SELECT t.label, t.id, t.text_obj, t.text_mthd, t.text_deal, uh.n, uh.n_ok,
                 {P.UP_MIN} // uh.n AS reps, {P.UP_MIN} % uh.n AS rem, {NONEMPTY} AS ok
          FROM train t JOIN uh ON t.label = uh.label),
copies AS (
  SELECT label, id, text_obj, text_mthd, text_deal,
         row_number() OVER (PARTITION BY label ORDER BY id, c) AS draw
  FROM (SELECT s.*, unnest(generate_series(2, reps)) AS c FROM small s)),
okr AS (
  SELECT *, row_number() OVER (PARTITION BY label
            ORDER BY md5('{P.SPLIT_SEED}:uniform:' || label || ':' || id), id) AS rk
  FROM small WHERE ok),
extra AS (
  SELECT label, id, text_obj, text_mthd, text_deal, (reps - 1) * n + j AS draw
  FROM (SELECT o.*, unnest(generate_series(rk, rem, n_ok)) AS j FROM okr o)),
up AS (
  SELECT label, id, text_obj, text_mthd, text_deal, 0 AS draw FROM train
  UNION ALL SELECT label, id, text_obj, text_mthd, text_deal, draw FROM copies
  UNION ALL SELECT label, id, text_obj, text_mthd, text_deal, draw FROM extra)
SELECT 'train' AS split, id, draw, label, {TEXT} AS text FROM up
UNION ALL
SELECT 'test' AS split, id, 0 AS draw, label, {TEXT} AS text FROM test"""

_BAG_BASE = bags_cte("same", base=split_from(LABELLED_BAGGING))
ORACLE["bagging_pipeline"] = "WITH " + _BAG_BASE + f""",
bh AS (SELECT bag_id, label, count(*) AS n FROM bags GROUP BY bag_id, label),
bt AS (SELECT bag_id, label, n,
              {test_k('n', f'(CAST({P.NUM_SUB_VALID} AS DOUBLE) / sum(n) OVER (PARTITION BY bag_id))')} AS k
       FROM bh),
parts AS (
  SELECT b.bag_id, b.id, b.label, b.text_obj, b.text_mthd, b.text_deal,
         CASE WHEN row_number() OVER (PARTITION BY b.bag_id, b.label
                   ORDER BY md5('{P.BAG_SEED}:split:' || b.bag_id || ':' || b.id), b.id) <= bt.k
              THEN 'valid' ELSE 'train' END AS part
  FROM bags b JOIN bt ON b.bag_id = bt.bag_id AND b.label = bt.label),
st AS (SELECT * FROM parts WHERE part = 'train'),
uh AS (SELECT bag_id, label, count(*) AS n,
              CAST(sum(CAST({NONEMPTY} AS INTEGER)) AS BIGINT) AS n_ok
       FROM st GROUP BY bag_id, label HAVING count(*) < {P.UP_MIN}),
okr AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.bag_id, s.label ORDER BY s.id) AS rk
  FROM st s JOIN uh ON s.bag_id = uh.bag_id AND s.label = uh.label
  WHERE {NONEMPTY.replace('text_', 's.text_')}),
draws AS (
  SELECT bag_id, label, j AS draw,
         CAST(floor({u(f"'{P.BAG_SEED}:random:' || bag_id || ':' || label || ':' || j")} * n_ok) + 1 AS BIGINT) AS rk
  FROM (SELECT uh.*, unnest(generate_series(1, {P.UP_MIN} - n)) AS j FROM uh))
SELECT bag_id, part, id, 0 AS draw, label, {TEXT} AS text FROM parts
UNION ALL
SELECT d.bag_id, 'train' AS part, o.id, d.draw, d.label,
       o.text_obj || ' ' || o.text_mthd || ' ' || o.text_deal AS text
FROM draws d JOIN okr o ON d.bag_id = o.bag_id AND d.label = o.label AND d.rk = o.rk
UNION ALL
SELECT NULL AS bag_id, 'test' AS part, id, 0 AS draw, label, {TEXT} AS text FROM test
UNION ALL
SELECT NULL AS bag_id, 'oob' AS part, id, 0 AS draw, label, {TEXT} AS text FROM train
WHERE id NOT IN (SELECT id FROM bags)"""

# ---------------------------------------------------------------- embeddings

EPS = "CAST(1e-9 AS DOUBLE)"

EMB = f"""
emb AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS label, embedding AS vec,
         CASE WHEN CAST(('0x' || substr(md5('42:' || vec_id), 1, 8)) AS BIGINT) % 10 < 7
              THEN 'train' ELSE 'test' END AS split
  FROM embeddings),
cls AS (
  SELECT label, chr(65 + label) || lpad(CAST(label * 3 AS VARCHAR), 2, '0')
                || lpad(CAST(label * 17 + 100 AS VARCHAR), 3, '0') AS digit
  FROM (SELECT DISTINCT label FROM emb)),
ev AS (
  SELECT e.id, e.label, e.split, CAST(m.range AS INTEGER) AS model,
         CAST(g.range AS INTEGER) AS pos, CAST(e.vec[m.range * 16 + g.range + 1] AS DOUBLE) AS v
  FROM emb e, range(4) m, range(16) g),
cent AS (SELECT model, label, pos, avg(v) AS w FROM ev WHERE split = 'train'
         GROUP BY model, label, pos),
sc AS (
  SELECT ev.model, ev.id, ev.label, ev.split, c.label AS cls, 8 * sum(ev.v * c.w) AS s
  FROM ev JOIN cent c ON c.model = ev.model AND c.pos = ev.pos
  GROUP BY ev.model, ev.id, ev.label, ev.split, c.label),
sm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY model, id)) AS ex FROM sc),
pr_all AS (SELECT model, id, label, split, cls,
                  ex / sum(ex) OVER (PARTITION BY model, id) AS p FROM sm),
pr AS (SELECT * FROM pr_all WHERE split = 'test'),
bp AS (
  SELECT model, id, label, cls AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY round(p, 9) DESC, cls) AS r
    FROM pr) WHERE r = 1),
bl AS (SELECT model, id, label, -ln(p + {EPS}) AS loss FROM pr WHERE cls = label),
pm AS (SELECT id, label, cls, avg(p) AS p FROM pr GROUP BY id, label, cls),
mean_pred AS (
  SELECT id, label, cls AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, cls) AS r FROM pm)
  WHERE r = 1),
mean_loss AS (SELECT id, -ln(p + {EPS}) AS loss FROM pm WHERE cls = label),
vote_pred AS (
  SELECT id, label, pred FROM (
    SELECT id, label, pred, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, pred) AS r
    FROM bp GROUP BY id, label, pred) WHERE r = 1),
ens AS (SELECT 'mean' AS agg_fn, id, label, pred FROM mean_pred
        UNION ALL SELECT 'vote' AS agg_fn, id, label, pred FROM vote_pred),
types AS (SELECT * FROM (VALUES ('bert', 0, 2), ('gpt', 1, 2)) t(type, type_order, n)),
rng AS (SELECT type, CAST(sum(n) OVER (ORDER BY type_order) - n AS INTEGER) AS lo,
               CAST(sum(n) OVER (ORDER BY type_order) AS INTEGER) AS hi FROM types),
asg AS (
  SELECT CAST(b.range AS INTEGER) AS bag_id, r.type, CAST(b.range - r.lo AS INTEGER) AS ith,
         CASE WHEN (b.range - r.lo) % 2 = 1 THEN 'FCE' ELSE 'ICE' END AS loss, r.lo, r.hi
  FROM range(4) b JOIN rng r ON b.range >= r.lo AND b.range < r.hi),
names AS (SELECT bag_id AS model, type || '_' || loss AS name FROM asg)"""


def per_class_sql(src: str, by: str) -> str:
    """Per-class scores of ``src`` (by, id, label, pred) over every class."""
    return f"""
pc_grid AS (SELECT g.{by}, c.label FROM (SELECT DISTINCT {by} FROM {src}) g, cls c),
pc_t AS (SELECT {by}, label, count(*) AS n_true,
                sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp FROM {src} GROUP BY ALL),
pc_p AS (SELECT {by}, pred AS label, count(*) AS n_pred FROM {src} GROUP BY ALL),
pc0 AS (
  SELECT g.{by}, g.label, coalesce(t.n_true, 0) AS n_true, coalesce(t.tp, 0) AS tp,
         coalesce(p.n_pred, 0) AS n_pred
  FROM pc_grid g LEFT JOIN pc_t t ON t.{by} = g.{by} AND t.label = g.label
  LEFT JOIN pc_p p ON p.{by} = g.{by} AND p.label = g.label),
pc1 AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
                  CASE WHEN n_true = 0 THEN 0.0 ELSE tp / n_true END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                      ELSE 2 * precision * recall / (precision + recall) END AS f1score FROM pc1),
macro AS (SELECT {by}, avg(precision) AS precision, avg(recall) AS recall,
                 avg(f1score) AS f1score FROM pc GROUP BY {by})"""


ORACLE["learner_assignment"] = f"WITH {EMB} " + \
    f"""SELECT type, bag_id, ith, loss, type || '_' || loss AS name, lo, hi, rows FROM asg,
  (SELECT CAST(sum(CASE WHEN n <= {P.MIN_CAT} THEN n
                        ELSE floor(e * n + ({P.MIN_CAT} - {P.MIN_CAT} * e)) END) AS BIGINT) AS rows
   FROM (SELECT n, CAST(sum(n) OVER () // {P.BAG_DIVISOR} AS DOUBLE) / sum(n) OVER () AS e
         FROM (SELECT count(*) AS n FROM emb WHERE split = 'train' GROUP BY label)))"""
ORACLE["model_names"] = f"WITH {EMB} SELECT model, name, count(*) AS rows FROM names " \
    "JOIN bp USING (model) GROUP BY model, name"
ORACLE["centroid_scores"] = f"WITH {EMB} SELECT model, id, cls AS class, p AS prob FROM pr"
ORACLE["score_all_models"] = f"WITH {EMB} SELECT model, id, label, pred FROM bp"
ORACLE["one_hot"] = f"WITH {EMB} " + """
SELECT e.id, CAST(g.range AS INTEGER) AS class,
       CASE WHEN g.range = e.label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS t
FROM emb e, range(10) g WHERE e.split = 'test'"""
ORACLE["ensemble_mean"] = f"WITH {EMB} SELECT id, label, pred FROM mean_pred"
ORACLE["ensemble_vote"] = f"WITH {EMB} SELECT id, label, pred FROM vote_pred"
ORACLE["ensemble_submission"] = f"WITH {EMB} " + """
SELECT e.id, substr(c.digit, 1, 1) AS digit_1, substr(c.digit, 2, 2) AS digit_2,
       substr(c.digit, 4) AS digit_3
FROM emb e LEFT JOIN mean_pred m ON m.id = e.id LEFT JOIN cls c ON c.label = m.pred
WHERE e.split = 'test'"""
ORACLE["confusion"] = f"WITH {EMB} SELECT agg_fn, label, pred, count(*) AS n FROM ens GROUP BY ALL"
ORACLE["per_class_metrics"] = f"WITH {EMB}, {per_class_sql('ens', 'agg_fn')} " + """
SELECT pc.agg_fn, pc.label AS class_id, c.digit AS class, pc.n_true AS n_test,
       pc.precision, pc.recall, pc.f1score
FROM pc JOIN cls c ON c.label = pc.label"""
ORACLE["macro_metrics"] = f"WITH {EMB}, {per_class_sql('ens', 'agg_fn')} " + """
SELECT a.agg_fn, a.n, round(a.accuracy, 6) AS accuracy, round(m.precision, 6) AS precision,
       round(m.recall, 6) AS recall, round(m.f1score, 6) AS f1score
FROM (SELECT agg_fn, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM ens GROUP BY agg_fn) a JOIN macro m ON m.agg_fn = a.agg_fn"""
ORACLE["model_metrics"] = f"WITH {EMB}, {per_class_sql('bp', 'model')} " + """
SELECT a.model, a.n, a.accuracy, l.loss, m.precision, m.recall, m.f1score
FROM (SELECT model, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM bp GROUP BY model) a
JOIN macro m ON m.model = a.model
JOIN (SELECT model, avg(loss) AS loss FROM bl GROUP BY model) l ON l.model = a.model"""
ORACLE["loss_ce"] = f"WITH {EMB} SELECT model, avg(loss) AS loss FROM bl GROUP BY model"
ORACLE["loss_fce"] = f"WITH {EMB} " + f"""
SELECT model, avg(-(pow(1 - p, 2) * 1 * ln(p + {EPS}))) AS loss
FROM pr WHERE cls = label GROUP BY model"""
ORACLE["loss_ice"] = f"WITH {EMB}, " + f"""
py AS (SELECT model, id, label, p,
              (row_number() OVER (PARTITION BY model ORDER BY id) - 1) // {P.BATCH_SIZE} AS batch_id
       FROM pr WHERE cls = label),
bc AS (SELECT model, batch_id, label, 1.0 / (count(*) + {EPS}) AS inv
       FROM py GROUP BY model, batch_id, label),
bs AS (SELECT model, batch_id, sum(inv) + ({P.EMB_CLASSES} - count(*)) / {EPS} AS den
       FROM bc GROUP BY model, batch_id)
SELECT py.model, avg(-(bc.inv / bs.den * {P.EMB_CLASSES}) * ln(py.p + {EPS})) AS loss
FROM py JOIN bc ON bc.model = py.model AND bc.batch_id = py.batch_id AND bc.label = py.label
JOIN bs ON bs.model = py.model AND bs.batch_id = py.batch_id
GROUP BY py.model"""
ORACLE["loss_weighted"] = f"WITH {EMB} " + """
SELECT model, avg(loss * CASE WHEN label = 0 THEN 0.0 ELSE 1.0 / (label + 1) END) AS loss
FROM bl GROUP BY model"""
ORACLE["loss_reductions"] = f"WITH {EMB} " + f"""
SELECT model, avg(loss) AS loss, 'mean' AS reduction FROM bl GROUP BY model
UNION ALL SELECT model, sum(loss), 'sum' FROM bl GROUP BY model
UNION ALL
SELECT model, avg(-ln(q + {EPS})), 'mean_softmax' FROM (
  SELECT model, id, label, cls, p / sum(p) OVER (PARTITION BY model, id) AS q FROM pr)
WHERE cls = label GROUP BY model"""

_EVALS = f"""
evals AS (
  SELECT 'centroid' AS run, a.model AS epoch,
         CASE WHEN a.split = 'train' THEN 'train' ELSE 'valid' END AS split, a.id, a.label,
         a.pred, -ln(b.p + {EPS}) AS loss
  FROM (SELECT model, id, label, split, cls AS pred FROM (
          SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY round(p, 9) DESC, cls) AS r
          FROM pr_all) WHERE r = 1) a
  JOIN pr_all b ON b.model = a.model AND b.id = a.id AND b.cls = b.label),
ev2 AS (SELECT run || ':' || epoch || ':' || split AS grp, * FROM evals)"""

ORACLE["epoch_summary"] = f"WITH {EMB}, {_EVALS}, {per_class_sql('ev2', 'grp')}, " + """
s AS (SELECT e.run, e.epoch, e.split, avg(e.loss) AS loss,
             avg(CASE WHEN e.label = e.pred THEN 1.0 ELSE 0.0 END) AS accuracy,
             any_value(m.precision) AS precision, any_value(m.recall) AS recall,
             any_value(m.f1score) AS f1score
      FROM ev2 e JOIN macro m ON m.grp = e.grp GROUP BY e.run, e.epoch, e.split)
SELECT t.run, t.epoch, t.loss AS train_loss, t.accuracy AS train_accuracy,
       t.precision AS train_precision, t.recall AS train_recall, t.f1score AS train_f1score,
       v.loss AS valid_loss, v.accuracy AS valid_accuracy, v.precision AS valid_precision,
       v.recall AS valid_recall, v.f1score AS valid_f1score
FROM s t JOIN s v ON v.run = t.run AND v.epoch = t.epoch AND v.split = 'valid'
WHERE t.split = 'train'"""

ORACLE["class_epoch_pivot"] = f"WITH {EMB}, {_EVALS}, " + \
    per_class_sql("(SELECT * FROM evals WHERE split = 'valid')", "epoch").replace(
        "(SELECT DISTINCT epoch FROM (SELECT * FROM evals WHERE split = 'valid'))",
        "(SELECT DISTINCT epoch FROM evals WHERE split = 'valid')") + """,
cnt AS (SELECT label, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS n_train,
               sum(CASE WHEN split = 'valid' THEN 1 ELSE 0 END) AS n_valid
        FROM evals WHERE epoch = 0 GROUP BY label)
SELECT pc.label, 'centroid' AS run,
       max(CASE WHEN epoch = 0 THEN f1score END) AS epoch_0,
       max(CASE WHEN epoch = 1 THEN f1score END) AS epoch_1,
       max(CASE WHEN epoch = 2 THEN f1score END) AS epoch_2,
       max(CASE WHEN epoch = 3 THEN f1score END) AS epoch_3,
       CAST(coalesce(any_value(cnt.n_train), 0) AS BIGINT) AS n_train,
       CAST(coalesce(any_value(cnt.n_valid), 0) AS BIGINT) AS n_valid,
       any_value(c.digit) AS digit
FROM pc LEFT JOIN cnt ON cnt.label = pc.label JOIN cls c ON c.label = pc.label
GROUP BY pc.label"""

_TS = """
SELECT 'mean' AS agg_fn, (SELECT avg(loss) FROM mean_loss) AS test_loss, a.accuracy,
       m.precision, m.recall, m.f1score
FROM acc a JOIN macro m ON m.agg_fn = a.agg_fn WHERE a.agg_fn = 'mean'
UNION ALL
SELECT 'vote', CAST(NULL AS DOUBLE), a.accuracy, m.precision, m.recall, m.f1score
FROM acc a JOIN macro m ON m.agg_fn = a.agg_fn WHERE a.agg_fn = 'vote'
UNION ALL
SELECT 'model' || a.agg_fn[2:], l.loss, a.accuracy, m.precision, m.recall, m.f1score
FROM acc a JOIN macro m ON m.agg_fn = a.agg_fn
JOIN (SELECT model, avg(loss) AS loss FROM bl GROUP BY model) l ON 'm' || l.model = a.agg_fn"""

ORACLE["test_summary"] = f"WITH {EMB}, all_ens AS (" + """
  SELECT agg_fn, id, label, pred FROM ens
  UNION ALL SELECT 'm' || model, id, label, pred FROM bp),""" + \
    per_class_sql("all_ens", "agg_fn")[1:] + """,
acc AS (SELECT agg_fn, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM all_ens GROUP BY agg_fn) """ + _TS

ORACLE["predictions"] = f"WITH {EMB} " + """
SELECT m.id AS doc, c1.digit AS category, c2.digit AS pred_mean, c3.digit AS pred_vote
FROM mean_pred m JOIN vote_pred v ON v.id = m.id
LEFT JOIN cls c1 ON c1.label = m.label LEFT JOIN cls c2 ON c2.label = m.pred
LEFT JOIN cls c3 ON c3.label = v.pred"""

# ---------------------------------------------------------------- subsets

_SUBSETS = """
npos AS (SELECT model, name, row_number() OVER (ORDER BY name) - 1 AS pos FROM names),
members AS (SELECT s.range AS mask, n.model, n.name FROM range(1, 16) s, npos n
            WHERE (s.range >> n.pos) & 1 = 1),
sname AS (SELECT mask, string_agg(name, '|' ORDER BY name) AS subset, count(*) AS size
          FROM members GROUP BY mask),
spm AS (SELECT m.mask, p.id, p.label, p.cls, avg(p.p) AS p
        FROM members m JOIN pr p ON p.model = m.model GROUP BY m.mask, p.id, p.label, p.cls),
spred AS (SELECT mask, id, label, cls AS pred FROM (
            SELECT *, row_number() OVER (PARTITION BY mask, id ORDER BY round(p, 9) DESC, cls) AS r
            FROM spm) WHERE r = 1),"""

SUBSET_METRICS = f"WITH {EMB}, {_SUBSETS} " + per_class_sql("spred", "mask")[1:] + """,
sm_out AS (
  SELECT s.subset, s.size, a.accuracy, m.precision, m.recall, m.f1score
  FROM sname s JOIN macro m ON m.mask = s.mask
  JOIN (SELECT mask, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM spred GROUP BY mask) a ON a.mask = s.mask)"""

ORACLE["subset_metrics"] = SUBSET_METRICS + " SELECT * FROM sm_out"
ORACLE["subset_top_acc"] = SUBSET_METRICS + \
    " SELECT subset, round(accuracy, 6) AS score FROM sm_out ORDER BY score DESC, subset DESC LIMIT 5"
ORACLE["subset_top_f1"] = SUBSET_METRICS + \
    " SELECT subset, round(f1score, 6) AS score FROM sm_out ORDER BY score DESC, subset DESC LIMIT 5"
ORACLE["subset_top_weighted"] = SUBSET_METRICS + \
    " SELECT subset, round(accuracy * 0.6 + f1score * (1 - 0.6), 6) AS score FROM sm_out " \
    "ORDER BY score DESC, subset DESC LIMIT 5"

ORACLE["subset_per_type"] = f"WITH {EMB}, " + """
typed AS (SELECT model, split_part(name, '_', 1) AS type FROM names),
kt AS (SELECT type, count(*) AS k FROM typed GROUP BY type),
wts AS (SELECT n.range AS n, t.model,
               CASE WHEN kt.k >= n.range THEN factorial(CAST(kt.k - 1 AS INTEGER))
                    / (factorial(CAST(n.range - 1 AS INTEGER))
                       * factorial(CAST(kt.k - n.range AS INTEGER))) ELSE 0 END AS w
        FROM range(1, 3) n, typed t JOIN kt ON kt.type = t.type),
wp AS (SELECT w.n, p.id, p.label, p.cls, sum(w.w * p.p) / sum(w.w) AS p
       FROM wts w JOIN pr p ON p.model = w.model WHERE w.w > 0 GROUP BY w.n, p.id, p.label, p.cls),
wpred AS (SELECT n, id, label, cls AS pred FROM (
            SELECT *, row_number() OVER (PARTITION BY n, id ORDER BY round(p, 9) DESC, cls) AS r
            FROM wp) WHERE r = 1),""" + per_class_sql("wpred", "n")[1:] + """
SELECT a.n, a.accuracy, m.precision, m.recall, m.f1score
FROM (SELECT n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM wpred GROUP BY n) a JOIN macro m ON m.n = a.n"""

# ---------------------------------------------------------------- histories

HIST = """
hv AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
         value AS loss, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS acc
  FROM events)"""

ORACLE["epoch_best"] = f"WITH {HIST} " + """
SELECT run, min(CASE WHEN loss = ml THEN epoch END) AS best_loss_epoch, ml AS best_loss,
       min(CASE WHEN acc = ma THEN epoch END) AS best_acc_epoch, ma AS best_acc
FROM (SELECT *, min(loss) OVER (PARTITION BY run) AS ml, max(acc) OVER (PARTITION BY run) AS ma
      FROM hv) GROUP BY run, ml, ma"""


def _early(op: str) -> str:
    return f"""
SELECT k.run, max(k.stop_epoch) AS stop_epoch, count(*) AS epochs_run,
       max(CASE WHEN k.improved THEN k.epoch END) AS best_epoch,
       max(CASE WHEN k.improved AND k.epoch = b.be THEN k.loss END) AS best_loss, '{op}' AS mode
FROM (
  SELECT h.*, st.stop_epoch FROM (
    SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (
             PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS counter
    FROM (SELECT *, best_before IS NULL OR loss {op} best_before AS improved FROM (
            SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
            FROM hv))) h
  LEFT JOIN (SELECT run, min(epoch) AS stop_epoch FROM (
      SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (
               PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS counter
      FROM (SELECT *, best_before IS NULL OR loss {op} best_before AS improved FROM (
              SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
              FROM hv)))
    WHERE counter >= {P.PATIENCE} GROUP BY run) st ON st.run = h.run
  WHERE st.stop_epoch IS NULL OR h.epoch <= st.stop_epoch) k
JOIN (SELECT run, max(epoch) AS be FROM (
        SELECT h.*, st2.stop_epoch FROM (
          SELECT *, best_before IS NULL OR loss {op} best_before AS improved FROM (
            SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM hv)) h
        LEFT JOIN (SELECT run, min(epoch) AS stop_epoch FROM (
          SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (
                   PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                   AS counter
          FROM (SELECT *, best_before IS NULL OR loss {op} best_before AS improved FROM (
                  SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
                  FROM hv)))
          WHERE counter >= {P.PATIENCE} GROUP BY run) st2 ON st2.run = h.run
        WHERE h.improved AND (st2.stop_epoch IS NULL OR h.epoch <= st2.stop_epoch))
      GROUP BY run) b ON b.run = k.run
GROUP BY k.run"""


ORACLE["early_stop"] = f"WITH {HIST} " + _early("<=") + " UNION ALL " + _early("<")

ORACLE["preview"] = f"WITH {LABELLED} " + f"""
SELECT id, digit, label, {TEXT} AS text FROM lab ORDER BY id LIMIT {P.PREVIEW_N}"""

# ---------------------------------------------------------------- encoding

WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda t: length(t) > 0)"
CHAR3 = "list_transform(range(1, length(lower(coalesce(text, ''))) - 1), " \
        "lambda i: substr(lower(coalesce(text, '')), i, 3))"

VOCAB = f"""
toks AS (SELECT 'word' AS view, unnest({WORDS}) AS token FROM documents
         UNION ALL
         SELECT 'char3' AS view, unnest({CHAR3}) AS token FROM documents),
cnt AS (SELECT view, token, count(*) AS n FROM toks GROUP BY view, token),
vocab AS (
  SELECT view, token, n, token_id FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY view ORDER BY n DESC, token) - 1 + 4 AS INTEGER)
              AS token_id FROM cnt)
  WHERE token_id < {P.VOCAB_SIZE} + 4)"""


def enc_view(view: str, toks: str, name: str) -> str:
    L = P.MAX_LEN
    return f"""
{name}_t AS (SELECT doc_id AS id, list_slice({toks}, 1, {L - 2}) AS toks FROM documents),
{name}_x AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_t),
{name}_i AS (
  SELECT x.id, list(coalesce(v.token_id, 1) ORDER BY x.pos) AS ids
  FROM {name}_x x LEFT JOIN vocab v ON v.view = '{view}' AND v.token = x.token GROUP BY x.id),
{name} AS (
  SELECT t.id, [2] || coalesce(i.ids, CAST([] AS INTEGER[])) || [3] AS seq
  FROM {name}_t t LEFT JOIN {name}_i i ON i.id = t.id),
{name}_e AS (
  SELECT id, array_to_string(list_resize(seq, {L}, 0), ',') AS input_ids,
         array_to_string(list_transform(range(1, {L + 1}),
                         lambda k: CASE WHEN k <= len(seq) THEN 1 ELSE 0 END), ',') AS attention_mask
  FROM {name})"""


ORACLE["vocab_top"] = f"WITH {VOCAB} SELECT view, token, n, token_id FROM vocab"

ORACLE["vocab_frequent"] = f"WITH {VOCAB} SELECT view, token, n, token_id FROM vocab WHERE token_id < {P.FREQUENT} + 4"

ORACLE["encode_fixed"] = f"WITH {VOCAB}, {enc_view('word', WORDS, 'w')} " + f"""
SELECT id, input_ids, attention_mask,
       array_to_string(list_resize(CAST([] AS INTEGER[]), {P.MAX_LEN}, 0), ',') AS token_type_ids
FROM w_e"""

ORACLE["encode_views"] = f"WITH {VOCAB}, {enc_view('word', WORDS, 'w')}, " \
    f"{enc_view('char3', CHAR3, 'c')} " + """
SELECT w.id, w.input_ids AS word_ids, c.input_ids AS char3_ids, true AS char3_no_types
FROM w_e w JOIN c_e c ON c.id = w.id"""

ORACLE["route_views"] = "WITH " + bags_cte("same") + f", {VOCAB}, " \
    f"{enc_view('word', WORDS, 'w')}, {enc_view('char3', CHAR3, 'c')}, " + f"""
types AS (SELECT * FROM (VALUES ('bert', 0, 2), ('gpt', 1, 2)) t(type, type_order, n)),
rng AS (SELECT type, sum(n) OVER (ORDER BY type_order) - n AS lo,
               sum(n) OVER (ORDER BY type_order) AS hi FROM types),
route AS (
  SELECT CAST(b.range AS INTEGER) AS bag_id,
         CASE r.type WHEN 'bert' THEN 'word' ELSE 'char3' END AS view
  FROM range({P.ESTIMATORS}) b JOIN rng r ON b.range >= r.lo AND b.range < r.hi)
SELECT b.bag_id, b.id, r.view,
       CASE WHEN r.view = 'word' THEN w.input_ids ELSE c.input_ids END AS input_ids
FROM bags b JOIN route r ON r.bag_id = b.bag_id
JOIN w_e w ON w.id = b.id JOIN c_e c ON c.id = b.id"""

# ---------------------------------------------------------------- random bags


def _size(bag: str, attempt: str) -> str:
    key = f"'{P.BAG_SEED}:size:' || {bag} || ':' || {attempt} || ':' || label"
    return f"(least({P.MIN_CAT}, n) + floor({u(key)} * (n - least({P.MIN_CAT}, n) + 1)))"


ORACLE["bag_random"] = "WITH RECURSIVE " + SPLIT + f""",
bhist AS (SELECT label, count(*) AS n FROM train GROUP BY label),
tt AS (SELECT sum(n) // {P.BAG_DIVISOR} AS total FROM bhist),
st(bag_id, attempt, cut, mode) AS (
  SELECT CAST(range AS INTEGER), 0, {P.CUT_STD}, CAST(NULL AS VARCHAR) FROM range({P.ESTIMATORS})
  UNION ALL
  SELECT st.bag_id,
         CASE WHEN a.s < a.total OR (a.s > a.total AND a.small > a.total)
              THEN st.attempt + 1 ELSE st.attempt END,
         CASE WHEN a.s > a.total AND a.small > a.total THEN st.cut - 100 ELSE st.cut END,
         CASE WHEN a.s = a.total THEN 'exact'
              WHEN a.s > a.total AND a.small <= a.total THEN 'cut' END
  FROM st, LATERAL (
    SELECT sum(s) AS s, sum(CASE WHEN s < st.cut THEN s ELSE 0 END) AS small,
           any_value(total) AS total
    FROM (SELECT {_size('st.bag_id', 'st.attempt')} AS s, total FROM bhist, tt)) a
  WHERE st.mode IS NULL),
fin AS (SELECT * FROM st WHERE mode IS NOT NULL),
sz AS (SELECT f.bag_id, f.mode, f.cut, h.label, h.n,
              CAST({_size('f.bag_id', 'f.attempt')} AS BIGINT) AS s
       FROM fin f, bhist h),
sv AS (SELECT bag_id, (SELECT total FROM tt) - sum(CASE WHEN s < cut THEN s ELSE 0 END) AS save
       FROM sz GROUP BY bag_id),
pool AS (SELECT bag_id, label, unnest(generate_series(1, s)) AS tok
         FROM sz WHERE mode = 'cut' AND s >= cut),
ppr AS (SELECT bag_id, label, row_number() OVER (PARTITION BY bag_id
              ORDER BY md5('{P.BAG_SEED}:pool:' || bag_id || ':' || label || ':' || tok), label) AS r
       FROM pool),
got AS (SELECT ppr.bag_id, ppr.label, count(*) AS got FROM ppr JOIN sv ON sv.bag_id = ppr.bag_id
        WHERE ppr.r <= sv.save GROUP BY ppr.bag_id, ppr.label),
rk_k AS (SELECT z.bag_id, z.label,
              CASE WHEN z.mode = 'cut' AND z.s >= z.cut THEN coalesce(g.got, 0) ELSE z.s END AS k
       FROM sz z LEFT JOIN got g ON g.bag_id = z.bag_id AND g.label = z.label),
rpairs AS (SELECT CAST(b.range AS INTEGER) AS bag_id, t.id, t.label FROM train t, range({P.ESTIMATORS}) b),
rbags AS (
  SELECT p.bag_id, p.id, p.label FROM (
    SELECT *, row_number() OVER (PARTITION BY bag_id, label
              ORDER BY md5('{P.BAG_SEED}:bag:' || bag_id || ':' || id), id) AS rk FROM rpairs) p
  JOIN rk_k ON rk_k.bag_id = p.bag_id AND rk_k.label = p.label WHERE p.rk <= rk_k.k)
SELECT bag_id, id, label FROM rbags"""

# The large classes' sizes drawn from the histogram: class by class in label
# order, each hypergeometric given what the classes before it left.
_TOKENS, _SIZES = "pool AS (SELECT bag_id, label, unnest", "rk_k AS (SELECT z.bag_id"
_SHARE_KEY = f"'{P.BAG_SEED}:share:' || bag_id || ':' || label"
_bag_random = ORACLE["bag_random"]
ORACLE["bag_random_histogram"] = _bag_random[:_bag_random.index(_TOKENS)] + f"""
lg AS (SELECT bag_id, label, s, {u(_SHARE_KEY)} AS u,
              row_number() OVER (PARTITION BY bag_id ORDER BY label) AS i
       FROM sz WHERE mode = 'cut' AND s >= cut),
ks AS (SELECT range AS k FROM range((SELECT max(n) + 1 FROM bhist))),
shares(bag_id, i, label, pool, m, got) AS (
  SELECT sv.bag_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(p.pool AS BIGINT), CAST(sv.save AS BIGINT),
         CAST(0 AS BIGINT)
  FROM sv JOIN (SELECT bag_id, sum(s) AS pool FROM lg GROUP BY bag_id) p ON p.bag_id = sv.bag_id
  UNION ALL
  SELECT q.bag_id, q.i, q.label, q.pool - q.s, q.m - q.got, q.got FROM (
    SELECT bag_id, i, label, pool, m, s,
           CAST(min(k) + count(*) FILTER (WHERE upto <= u) AS BIGINT) AS got
    FROM (
      SELECT *, sum(exp(lgamma(s + 1) - lgamma(k + 1) - lgamma(s - k + 1)
                        + lgamma(pool - s + 1) - lgamma(m - k + 1) - lgamma(pool - s - m + k + 1)
                        - lgamma(pool + 1) + lgamma(m + 1) + lgamma(pool - m + 1)))
                OVER (PARTITION BY bag_id ORDER BY k) AS upto
      FROM (SELECT d.bag_id, l.i, l.label, d.pool, d.m, l.s, l.u, ks.k
            FROM shares d JOIN lg l ON l.bag_id = d.bag_id AND l.i = d.i + 1
            JOIN ks ON ks.k BETWEEN greatest(0, d.m - (d.pool - l.s)) AND least(d.m, l.s)))
    GROUP BY bag_id, i, label, pool, m, s) q),
got AS (SELECT bag_id, label, got FROM shares WHERE i > 0),
""" + _bag_random[_bag_random.index(_SIZES):]

# ---------------------------------------------------------------- text learners

TEXT_MODEL = bags_cte("same") + f""",
tx AS (SELECT id, label, split, {TEXT} AS text FROM split),
tok AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {P.TEXT_DIMS} AS pos
        FROM (SELECT id, unnest({WORDS}) AS w FROM tx)),
tf AS (SELECT id, pos, count(*) / CAST(sum(count(*)) OVER (PARTITION BY id) AS DOUBLE) AS v
       FROM tok GROUP BY id, pos),
cn AS (SELECT bag_id AS model, label, count(*) AS n FROM bags GROUP BY bag_id, label),
ct AS (SELECT b.bag_id AS model, b.label, tf.pos, sum(tf.v) AS s
       FROM bags b JOIN tf ON tf.id = b.id GROUP BY ALL),
w AS (SELECT ct.model, ct.label, ct.pos, ct.s / cn.n AS w
      FROM ct JOIN cn ON cn.model = ct.model AND cn.label = ct.label),
hit AS (SELECT t.id, w.model, w.label AS cls, sum(tf.v * w.w) AS s
        FROM tx t JOIN tf ON tf.id = t.id JOIN w ON w.pos = tf.pos
        WHERE t.split = 'test' GROUP BY ALL),
sc AS (SELECT t.id, t.label, cn.model, cn.label AS cls, {P.TEXT_SCALE} * coalesce(h.s, 0) AS s
       FROM tx t CROSS JOIN cn
       LEFT JOIN hit h ON h.id = t.id AND h.model = cn.model AND h.cls = cn.label
       WHERE t.split = 'test'),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY model, id)) AS e FROM sc),
pr AS (SELECT model, id, label, cls, e / sum(e) OVER (PARTITION BY model, id) AS p FROM ex),
bp AS (SELECT model, id, label, cls AS pred FROM pr
       QUALIFY row_number() OVER (PARTITION BY model, id ORDER BY round(p, 9) DESC, cls) = 1),
pm AS (SELECT id, label, cls, avg(p) AS p FROM pr GROUP BY id, label, cls),
mean_pred AS (SELECT id, label, cls AS pred FROM pm
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, cls) = 1),
vote_pred AS (SELECT id, label, pred FROM bp GROUP BY id, label, pred
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, pred) = 1),
cls AS (SELECT label FROM dim),
ens AS (SELECT 'mean' AS agg_fn, id, label, pred FROM mean_pred
        UNION ALL SELECT 'vote' AS agg_fn, id, label, pred FROM vote_pred)"""

ORACLE["text_bagging_summary"] = f"WITH {TEXT_MODEL}, {per_class_sql('ens', 'agg_fn')} " + """
SELECT a.agg_fn, a.n, a.accuracy, m.precision, m.recall, m.f1score
FROM (SELECT agg_fn, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM ens GROUP BY agg_fn) a JOIN macro m ON m.agg_fn = a.agg_fn"""

ORACLE["inference_codes"] = f"WITH {TEXT_MODEL} " + """
SELECT m.id, substr(d.digit, 1, 1) AS digit_1, substr(d.digit, 2, 2) AS digit_2,
       substr(d.digit, 4) AS digit_3
FROM mean_pred m JOIN dim d ON d.label = m.pred"""

# Every record is scored by the models of the bags, copies and training rows too.
ORACLE["inference_all_codes"] = f"WITH {TEXT_MODEL}" + f""",
atx AS (SELECT id, {TEXT} AS text FROM filled),
atok AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {P.TEXT_DIMS} AS pos
         FROM (SELECT id, unnest({WORDS}) AS w FROM atx)),
atf AS (SELECT id, pos, count(*) / CAST(sum(count(*)) OVER (PARTITION BY id) AS DOUBLE) AS v
        FROM atok GROUP BY id, pos),
ahit AS (SELECT atf.id, w.model, w.label AS cls, sum(atf.v * w.w) AS s
         FROM atf JOIN w ON w.pos = atf.pos GROUP BY ALL),
asc0 AS (SELECT t.id, cn.model, cn.label AS cls, {P.TEXT_SCALE} * coalesce(h.s, 0) AS s
         FROM atx t CROSS JOIN cn
         LEFT JOIN ahit h ON h.id = t.id AND h.model = cn.model AND h.cls = cn.label),
aex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY model, id)) AS e FROM asc0),
apr AS (SELECT model, id, cls, e / sum(e) OVER (PARTITION BY model, id) AS p FROM aex),
apm AS (SELECT id, cls, avg(p) AS p FROM apr GROUP BY id, cls),
apred AS (SELECT id, cls AS pred FROM apm
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, cls) = 1)
SELECT a.id, substr(d.digit, 1, 1) AS digit_1, substr(d.digit, 2, 2) AS digit_2,
       substr(d.digit, 4) AS digit_3
FROM apred a JOIN dim d ON d.label = a.pred"""


# ---------------------------------------------------------------- networks

ORACLE["batch_gradients"] = f"""
WITH e AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, embedding::DOUBLE[] AS vec FROM embeddings
           WHERE ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT % 10 < 7),
bag AS (SELECT m::INTEGER AS model, id, label, vec, md5('{P.BAG_SEED}:batch:' || m || ':' || id) AS k
        FROM e, range({P.NETWORKS}) AS t(m)
        WHERE ('0x' || substr(md5('{P.BAG_SEED}:net:' || m || ':' || id), 1, 13))::BIGINT / {float(2 ** 52)} < {P.NETWORK_SHARE}),
st AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY k, id) - 1) // {P.BATCH_SIZE} AS step FROM bag),
z AS (SELECT model, step, id, label, c, list_dot_product(vec, list_transform(range(len(vec)),
             lambda j: ((7 * c + 3 * j + model) % 11 - 5) / 20.0)) + (c % 3 - 1) / 10.0 AS z
      FROM st, range({P.EMB_CLASSES}) AS t(c)),
x AS (SELECT *, exp(z - max(z) OVER w) AS x FROM z WINDOW w AS (PARTITION BY model, id)),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY model, id) AS p FROM x),
cc AS (SELECT model, step, label, 1.0 / (count(*) + {EPS}) AS inv FROM st GROUP BY ALL),
cs AS (SELECT model, step, sum(inv) + ({P.EMB_CLASSES} - count(*)) / {EPS} AS den FROM cc GROUP BY ALL),
r AS (SELECT p.model, p.step, p.id, p.label, p.p AS py,
             CASE WHEN p.model % 3 = 2 THEN cc.inv / cs.den * {P.EMB_CLASSES} ELSE 1.0 END AS w
      FROM p JOIN cc USING (model, step, label) JOIN cs USING (model, step) WHERE p.c = p.label),
k AS (SELECT *, CASE WHEN model % 3 = 1 THEN -pow(1 - py, 2) * ln(py + {EPS}) ELSE -w * ln(py + {EPS}) END AS loss,
             py * (CASE WHEN model % 3 = 1 THEN 2 * (1 - py) * ln(py + {EPS}) - pow(1 - py, 2) / (py + {EPS})
                   ELSE -w / (py + {EPS}) END) AS slope FROM r),
f AS (SELECT model, id, pos, unnest AS v FROM (
        SELECT model, id, unnest(list_append(vec, 1.0)) AS unnest, generate_subscripts(list_append(vec, 1.0), 1) AS pos FROM st)),
g AS (SELECT p.model, p.step, c, pos, sum(slope * ((c = p.label)::INTEGER - p.p) * v) AS g
      FROM p JOIN k ON p.model = k.model AND p.id = k.id JOIN f ON f.model = p.model AND f.id = p.id GROUP BY ALL),
n AS (SELECT model, step, sqrt(sum(g * g)) AS norm FROM g GROUP BY ALL),
l AS (SELECT model, step, count(*) AS n, avg(loss) AS loss FROM k GROUP BY ALL)
SELECT model, step, l.n, l.loss, norm / l.n AS norm FROM l JOIN n USING (model, step)"""

ORACLE["evaluator_state"] = ORACLE["model_metrics"]
