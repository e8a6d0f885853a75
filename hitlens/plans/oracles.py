"""The same queries in DuckDB's SQL, for comparison."""

from __future__ import annotations

from hitlens.functions.alphabets import DAYHOFF, HP
from hitlens.plans.adapters import SCORES, SEGMENTS
from hitlens.schema import COUNTS, LEVELS, SAME

_BASE = f"""
ent AS (
  SELECT c_custkey AS key, 'd' || c_custkey || '_ ' || chr(97 + n_regionkey) || '.' || (n_nationkey + 1) || '.' || coalesce(list_position({SEGMENTS}, c_mktsegment), 0) || '.' || (c_custkey % 3) || ' (A:) ' || c_mktsegment AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), parsed AS (
  SELECT DISTINCT name, split_part(name, ' ', 1) AS id, split_part(name, ' ', 2) AS family, regexp_extract(name, ' ([a-z]\\.\\d+\\.\\d+)\\.\\d+', 1) AS superfamily,
    regexp_extract(name, ' ([a-z]\\.\\d+)', 1) AS fold, regexp_extract(name, ' ([a-z])\\.', 1) AS class
  FROM ent
), meta AS (
  SELECT *, count(*) OVER (PARTITION BY family) AS n_family, count(*) OVER (PARTITION BY superfamily) AS n_superfamily, count(*) OVER (PARTITION BY fold) AS n_fold, count(*) OVER (PARTITION BY class) AS n_class FROM parsed
), post AS (
  SELECT DISTINCT o_custkey AS key, l_partkey AS element FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), size AS (
  SELECT key, count(*) AS n FROM post GROUP BY key
), pair AS (
  SELECT a.key AS q, b.key AS m, count(*) AS i FROM post a JOIN post b USING (element) GROUP BY 1, 2
), hit AS (
  SELECT eq.name AS query_name, em.name AS match_name, i::DOUBLE AS intersect_hashes, i / sq.n AS containment, i / least(sq.n, sm.n) AS max_containment, i / (sq.n + sm.n - i) AS jaccard
  FROM pair JOIN size sq ON sq.key = q JOIN size sm ON sm.key = m JOIN ent eq ON eq.key = q JOIN ent em ON em.key = m
), clean AS (
  SELECT hit.*, a.id AS query_scop_id, b.id AS match_scop_id, log10(containment) AS log10_containment, log10(max_containment) AS log10_max_containment, log10(jaccard) AS log10_jaccard,
    {", ".join(f"a.{v} AS query_{v}, b.{v} AS match_{v}, a.{v} = b.{v} AS same_{v}, a.n_{v}" for v in LEVELS)}, 'protein' AS moltype, 10 AS ksize
  FROM hit JOIN meta a ON a.name = query_name JOIN meta b ON b.name = match_name
  WHERE query_name <> match_name AND intersect_hashes > 1
), tied AS (
  SELECT * REPLACE (round(containment, 9) AS containment, round(max_containment, 9) AS max_containment, round(jaccard, 9) AS jaccard, round(log10_jaccard, 9) AS log10_jaccard) FROM clean
)"""


def _long(scores, source="tied"):
    """(…, score_name, score_value) of a table, one row a score."""
    return " UNION ALL ".join(f"SELECT *, '{s}' AS score_name, {s}::DOUBLE AS score_value FROM {source}" for s in scores)


def _sens(scores, none="count(*)", ties="match_name"):
    levels = ", ".join(f"round(CASE WHEN any_value(n_{v}) > 1 THEN coalesce(min(CASE WHEN NOT same_{v} THEN rn END) - 1, {none}) / (any_value(n_{v}) - 1) ELSE 0 END, 9) AS sensitivity_{v}" for v in LEVELS)
    return f""", long AS ({_long(scores)}), rank AS (
  SELECT *, row_number() OVER (PARTITION BY query_scop_id, score_name ORDER BY score_value DESC, {ties}) AS rn FROM long
), sens AS (
  SELECT query_scop_id, score_name, {levels} FROM rank GROUP BY ALL
), tidy AS (
  {" UNION ALL ".join(f"SELECT query_scop_id, score_name, '{v}' AS lineage, sensitivity_{v} AS sensitivity FROM sens" for v in LEVELS)}
)"""


def _with(rest, more=""):
    return f"WITH {_BASE}{more} {rest}"


def _levels_long(source):
    return " UNION ALL ".join(f"SELECT *, '{v}' AS scop_level, same_{v} AS is_same FROM ({source})" for v in LEVELS)


_RAW = _long(SCORES, "clean")
_BOTH = _long(["containment", "jaccard"])


def _thresholds(rows, groups):
    keys = ", ".join(groups)
    part = f"PARTITION BY {keys}" if groups else ""
    return f""", counts AS (
  SELECT {keys + "," if groups else ""} s AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM ({rows}) GROUP BY ALL
), cumulative AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY threshold DESC) AS tp, sum(neg) OVER ({part} ORDER BY threshold DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM counts
), t AS (SELECT * FROM cumulative WHERE p > 0 AND n > 0)"""


_BINARY = _thresholds(f"SELECT score_name, scop_level, is_same::INT AS y, score_value AS s FROM ({_levels_long(_BOTH)})", ["score_name", "scop_level"])
_SUMMARY = "round(sum(pos / p * tp / (tp + fp)), 9) AS average_precision, round(sum(neg / n * (tp - pos / 2) / p), 9) AS roc_auc, any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives"


def _translate(groups):
    return f"'{''.join(groups.values())}', '{''.join(k * len(v) for k, v in groups.items())}'"


_SEQ = "seq AS (SELECT p_partkey AS key, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part)"


def _kmers(text, k):
    return f"list_transform(range(1, greatest(length({text}) - {k} + 2, 1)), lambda i: substr({text}, i, {k}))"


def _rows(k, text):
    return f"km AS (SELECT key, i - 1 AS start, substr(s, i, {k}) AS kmer, substr(e, i, {k}) AS encoded FROM (SELECT key, s, {text} AS e, unnest(range(1, greatest(length(s) - {k} + 2, 1))) AS i FROM seq))"


_PAIRS = f"""
WITH {_SEQ}, pairs AS (SELECT a.key::VARCHAR AS query, b.key::VARCHAR AS match, a.s AS qs, b.s AS ms FROM seq a JOIN seq b ON b.key = a.key + 1),
sets AS (SELECT query, match, k AS ksize, {_kmers("translate(qs, ALPHABET)", "k")} AS q, {_kmers("translate(ms, ALPHABET)", "k")} AS m FROM pairs, range(KLOW, KHIGH) r(k)),
shared AS (SELECT *, list_intersect(list_distinct(q), list_distinct(m)) AS inter FROM sets),
positions AS (SELECT *, list_sort(list_transform(inter, lambda x: {{'pos': list_position(q, x) - 1, 'kmer': x}})) AS places FROM shared)
"""


def _pairs(alphabet, low, high):
    return _PAIRS.replace("ALPHABET", _translate(alphabet)).replace("KLOW", str(low)).replace("KHIGH", str(high))


_ISLANDS = f"""{_SEQ}, {_rows(4, f"translate(s, {_translate(HP)})")}, common AS (
  SELECT DISTINCT km.key, start FROM km WHERE (key + 1, encoded) IN (SELECT (key, encoded) FROM km)
), island AS (
  SELECT key::VARCHAR AS name, min(start) AS first, max(start) AS last, count(*) AS n FROM (SELECT key, start, start - row_number() OVER (PARTITION BY key ORDER BY start) AS run FROM common) GROUP BY key, run
)"""

_PREDICTED = """, best AS (SELECT query_scop_id, match_class, max(jaccard) AS v FROM tied GROUP BY ALL),
filled AS (SELECT q.query_scop_id, l.class, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT query_scop_id FROM tied) q CROSS JOIN (SELECT DISTINCT class FROM meta) l LEFT JOIN best b ON b.query_scop_id = q.query_scop_id AND b.match_class = l.class),
chosen AS (SELECT query_scop_id, class AS predicted, v AS score FROM filled QUALIFY row_number() OVER (PARTITION BY query_scop_id ORDER BY v DESC, class) = 1),
pred AS (SELECT chosen.*, meta.class AS query_class FROM chosen JOIN meta ON id = query_scop_id)"""
_REPORT = """, label AS (SELECT query_class AS label FROM pred UNION SELECT predicted FROM pred),
report AS (SELECT label, (SELECT count(*) FROM pred WHERE query_class = label AND predicted = label) AS tp, (SELECT count(*) FROM pred WHERE query_class = label) AS support,
  (SELECT count(*) FROM pred WHERE predicted = label) AS predicted FROM label)"""

ORACLES = {
    "hits_clean": _with(
        "SELECT query_scop_id, match_scop_id, intersect_hashes, "
        + ", ".join(f"round({c}, 9) AS {c}" for c in ("containment", "max_containment", "jaccard", "log10_containment", "log10_max_containment", "log10_jaccard"))
        + f", {', '.join(SAME + COUNTS)}, moltype, ksize FROM clean"
    ),
    "hits_left_annotated": _with(
        f"""SELECT a.class AS query_class, coalesce(b.class, 'none') AS match_class, count(*) AS n, {", ".join(f"sum(coalesce(a.{v} = b.{v}, false)::INT)::BIGINT AS same_{v}" for v in LEVELS)}
        FROM hit JOIN meta a ON a.name = query_name LEFT JOIN (SELECT * FROM meta WHERE family NOT LIKE 'b.%') b ON b.name = match_name WHERE query_name <> match_name AND intersect_hashes > 1 GROUP BY 1, 2"""
    ),
    "hits_self_by_name": _with("SELECT query_name, count(*) AS n, sum(intersect_hashes) AS shared FROM hit WHERE query_name <> match_name GROUP BY 1"),
    "lineage_extract": _with(
        """SELECT name AS query_name, id AS query_scop_id, family AS query_lineage_original, lin AS query_lineage, lin AS query_family, regexp_extract(lin, '^(.*)\\.', 1) AS query_superfamily,
        regexp_extract(lin, '^([a-z]\\.\\d+)', 1) AS query_fold, substr(lin, 1, 1) AS query_class FROM (SELECT *, CASE WHEN family LIKE 'c.%' THEN 'z.9.9.9' ELSE family END AS lin FROM parsed)"""
    ),
    "lineage_changes": _with("SELECT id AS query_scop_id, family AS query_lineage_original, 'z.9.9.9' AS query_lineage FROM parsed WHERE family LIKE 'c.%'"),
    "level_sizes": _with(" UNION ALL ".join(f"SELECT '{v}' AS level, {v} AS label, count(*) AS n FROM parsed GROUP BY {v}" for v in LEVELS)),
    "query_metadata": _with(f"SELECT name AS query_name, id AS query_scop_id, {', '.join(f'{v} AS query_{v}, n_{v}' for v in LEVELS)} FROM meta"),
    "sensitivity_first_fp": _with("SELECT * FROM sens", _sens(SCORES)),
    "sensitivity_argmin": _with("SELECT * FROM sens", _sens(["jaccard"], none="0")),
    "sensitivity_all_queries": _with(
        f"SELECT id AS query_scop_id, 'containment' AS score_name, {', '.join(f'coalesce(sensitivity_{v}, 0) AS sensitivity_{v}' for v in LEVELS)} FROM meta LEFT JOIN sens ON id = query_scop_id",
        _sens(["containment"], ties="same_class DESC, same_fold DESC, same_superfamily DESC, same_family DESC, match_name"),
    ),
    "sensitivity_tidy_ranked": _with("SELECT *, (row_number() OVER (PARTITION BY score_name, lineage ORDER BY sensitivity DESC, query_scop_id))::INT AS sensitivity_rank FROM tidy", _sens(SCORES)),
    "sensitivity_fraction": _with(
        """SELECT *, CASE WHEN n > 1 THEN round((sensitivity_rank - 1) / (n - 1), 9) ELSE 0 END AS fraction_queries FROM (SELECT *, (row_number() OVER (PARTITION BY lineage ORDER BY sensitivity DESC, query_scop_id))::INT AS sensitivity_rank,
        count(*) OVER (PARTITION BY lineage) AS n FROM tidy)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (n), CASE", 1),
        _sens(["jaccard"]),
    ),
    "sensitivity_joined": _with("SELECT query_scop_id, lineage, sensitivity, family AS query_family, class AS query_class, n_family FROM tidy JOIN meta ON id = query_scop_id WHERE sensitivity > 0 AND sensitivity <= 1", _sens(["jaccard"])),
    "sensitivity_summary": _with("SELECT score_name, lineage, round(avg(sensitivity), 9) AS mean, round(median(sensitivity), 9) AS median, max(sensitivity) AS max, count(*) AS n FROM tidy GROUP BY ALL", _sens(SCORES)),
    "best_queries": _with(
        """SELECT *, 'most' AS which FROM tidy QUALIFY row_number() OVER (PARTITION BY score_name, lineage ORDER BY sensitivity DESC, query_scop_id) = 1
        UNION ALL SELECT *, 'least' AS which FROM tidy QUALIFY row_number() OVER (PARTITION BY score_name, lineage ORDER BY sensitivity, query_scop_id) = 1""",
        _sens(SCORES),
    ),
    "running_tp": _with(
        """SELECT query_scop_id, max(tp)::BIGINT AS tp, sum(clean)::BIGINT AS leading, sum(tp)::BIGINT AS area FROM (SELECT query_scop_id, sum(same_class::INT) OVER w AS tp, min(same_class::INT) OVER w AS clean
        FROM rank WINDOW w AS (PARTITION BY query_scop_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
        _sens(["jaccard"]),
    ),
    "same_counts": _with(
        f"""SELECT query_scop_id, {", ".join(f"same_{v}, same_{v} > 0 AS any_{v}, CASE WHEN n_{v} > 1 THEN round(same_{v} / (n_{v} - 1), 9) ELSE 0 END AS recall_{v}" for v in LEVELS)} FROM (
        SELECT query_scop_id, {", ".join(f"any_value(n_{v}) AS n_{v}, sum(same_{v}::INT)::BIGINT AS same_{v}" for v in LEVELS)} FROM clean GROUP BY 1)"""
    ),
    "score_level_counts": _with(f"SELECT score_name, scop_level, is_same, count(*) AS n, round(sum(score_value), 6) AS total, round(min(score_value), 6) AS least, round(max(score_value), 6) AS most FROM ({_levels_long(_RAW)}) GROUP BY ALL"),
    "score_means": _with(
        f"""SELECT moltype, ksize, score_name, scop_level, is_same, count(*) AS n, round(avg(score_value), 7) AS mean, round(median(score_value), 7) AS median, round(quantile_cont(score_value, 0.25), 7) AS q1,
        round(quantile_cont(score_value, 0.75), 7) AS q3, round(stddev_samp(score_value), 7) AS sd FROM ({_levels_long(_RAW)}) GROUP BY ALL"""
    ),
    "score_histogram": _with("SELECT same_class, CASE WHEN jaccard >= 0.25 THEN 11 ELSE floor(jaccard / 0.25 * 10)::BIGINT + 1 END AS bin, count(*) AS n FROM tied GROUP BY ALL"),
    "value_counts_top5": _with("SELECT superfamily AS query_superfamily, count(*) AS n FROM meta GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"),
    "value_counts_multi": _with(f"SELECT {', '.join(SAME)}, count(*) AS n FROM clean GROUP BY ALL"),
    "distinct_labels": _with(f"SELECT query_class, {', '.join(f'count(DISTINCT match_{v}) AS n_match_{v}' for v in LEVELS)}, array_to_string(list_sort(list_distinct(list(match_class))), ',') AS classes FROM clean GROUP BY 1"),
    "pivot_max": _with("SELECT query_scop_id, " + ", ".join(f"round(coalesce(max(jaccard) FILTER (match_class = '{c}'), 0), 9) AS {c}" for c in "abcde") + " FROM clean GROUP BY 1"),
    "predicted_class": _with("SELECT query_scop_id, predicted, score, query_class FROM pred", _PREDICTED),
    "true_class_score": _with("SELECT query_scop_id, coalesce(max(jaccard) FILTER (query_class = match_class), 0) AS score FROM tied GROUP BY 1"),
    "confusion_long": _with("SELECT query_class AS y_true, predicted AS y_pred, count(*) AS n FROM pred GROUP BY ALL", _PREDICTED),
    "class_report": _with(
        """SELECT label, tp, support, predicted, CASE WHEN predicted > 0 THEN round(tp / predicted, 9) ELSE 0 END AS precision, CASE WHEN support > 0 THEN round(tp / support, 9) ELSE 0 END AS recall,
        CASE WHEN support + predicted > 0 THEN round(2 * tp / (support + predicted), 9) ELSE 0 END AS f1 FROM report""",
        _PREDICTED + _REPORT,
    ),
    "macro_scores": _with(
        """SELECT 'protein' AS moltype, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(CASE WHEN support > 0 THEN tp / support END), 9) AS balanced_accuracy, round(avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END), 9) AS macro_precision,
        round(avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END), 9) AS macro_recall, round(avg(2 * tp / (support + predicted)), 9) AS macro_f1
        FROM (SELECT label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
          SELECT query_fold AS label, (query_fold = match_fold)::INT AS tp, 1 AS support, 0 AS predicted FROM tied UNION ALL SELECT match_fold, 0, 0, 1 FROM tied) GROUP BY label)"""
    ),
    "roc_auc_ap": _with(f"SELECT score_name, scop_level, {_SUMMARY} FROM t GROUP BY ALL", _BINARY),
    "pr_curve": _with(
        """SELECT score_name, scop_level, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall, threshold FROM t
        UNION ALL SELECT score_name, scop_level, 1.0, 0.0, max(threshold) FROM t GROUP BY ALL""",
        _BINARY,
    ),
    "roc_curve": _with(
        """SELECT score_name, scop_level, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr, threshold FROM (SELECT *, lead(pos) OVER w AS pos1, lead(neg) OVER w AS neg1 FROM t WINDOW w AS (PARTITION BY score_name, scop_level ORDER BY threshold DESC))
        WHERE pos1 IS NULL OR pos * neg1 <> neg * pos1 UNION ALL SELECT DISTINCT score_name, scop_level, 0.0, 0.0, 'inf'::DOUBLE FROM t""",
        _BINARY,
    ),
    "det_curve": _with(
        """SELECT t.score_name, t.scop_level, round(fp / n, 9) AS fpr, round(1 - tp / p, 9) AS fnr, threshold FROM t JOIN (
        SELECT score_name, scop_level, coalesce(min(threshold) FILTER (fp = 0), max(threshold)) AS hi, max(threshold) FILTER (tp = p) AS lo FROM t GROUP BY ALL) e USING (score_name, scop_level) WHERE threshold <= hi AND threshold >= lo""",
        _BINARY,
    ),
    "quality_by_length": "WITH " + _thresholds("SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)", [])[2:] + f" SELECT {_SUMMARY} FROM t",
    "zeroed_self_scores": _with("SELECT query_name, round(max(CASE WHEN query_name = match_name THEN 0 ELSE containment END), 9) AS containment, round(max(CASE WHEN query_name = match_name THEN 0 ELSE jaccard END), 9) AS jaccard FROM hit GROUP BY 1"),
    "reciprocal_scores": _with("SELECT query_scop_id, round(min(1 / containment), 9) AS least, round(max(1 / containment), 9) AS most FROM clean GROUP BY 1"),
    "labels_within_queries": _with("SELECT CASE WHEN match_fold IN (SELECT fold FROM meta WHERE class IN ('a', 'b')) THEN match_fold END AS match_fold, count(*) AS n FROM clean GROUP BY 1"),
    "seeded_sample": _with("SELECT query_scop_id, match_scop_id, round(jaccard, 9) AS jaccard FROM clean WHERE query_scop_id IN (SELECT id FROM meta ORDER BY md5('0:' || id), id LIMIT 50)"),
    "page_of_queries": _with("SELECT id AS query_scop_id, family AS query_family FROM meta ORDER BY id LIMIT 10 OFFSET 20"),
    "keep_first": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "union_sources": "SELECT kind, nation, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL",
    "kmer_sets": f"WITH {_SEQ}, k AS (SELECT key, k, {_kmers(f'translate(s, {_translate(HP)})', 'k')} AS f FROM seq, range(3, 7) r(k)) SELECT key::VARCHAR AS name, k::INT AS k, len(f)::INT AS n_kmers, len(list_distinct(f))::INT AS n_unique FROM k",
    "kmer_jaccard_sweep": _pairs(HP, 3, 7)
    + """SELECT query, match, ksize::INT AS ksize, len(q)::INT AS query_n_kmers, len(list_distinct(q))::INT AS query_n_unique_kmers, len(m)::INT AS match_n_kmers, len(list_distinct(m))::INT AS match_n_unique_kmers,
    len(inter)::INT AS intersection, (len(list_distinct(q)) + len(list_distinct(m)) - len(inter))::INT AS union,
    CASE WHEN len(q) + len(m) > 0 THEN round(len(inter) / (len(list_distinct(q)) + len(list_distinct(m)) - len(inter)), 9) ELSE 0 END AS jaccard FROM shared""",
    "kmer_positions": _pairs(DAYHOFF, 4, 5) + "SELECT query, match, coalesce(array_to_string(list_transform(places, lambda p: p.pos || ':' || p.kmer), ','), '') AS positions FROM positions",
    "window_position_filter": _pairs(DAYHOFF, 4, 5) + "SELECT query, match, ksize::INT AS ksize, len(inter)::INT AS intersection FROM positions WHERE len(list_filter(places, lambda p: p.pos BETWEEN 2 AND 5)) > 0",
    "kmer_containment": _with(
        """SELECT q AS query, m AS match, sq.n AS n_query, sm.n AS n_match, i AS common, sq.n - i AS only_query, sm.n - i AS only_match, sq.n + sm.n - i AS union, round(i / sq.n, 9) AS containment,
        round(i / least(sq.n, sm.n), 9) AS max_containment, round(i / (sq.n + sm.n - i), 9) AS jaccard FROM pair JOIN size sq ON sq.key = q JOIN size sm ON sm.key = m WHERE i > 1"""
    ),
    "kmer_containment_all": _with(
        """SELECT q AS query, m AS match, sq.n AS n_query, sm.n AS n_match, i AS common, sq.n - i AS only_query, sm.n - i AS only_match, sq.n + sm.n - i AS union, round(i / sq.n, 9) AS containment,
        round(i / least(sq.n, sm.n), 9) AS max_containment, round(i / (sq.n + sm.n - i), 9) AS jaccard FROM pair JOIN size sq ON sq.key = q JOIN size sm ON sm.key = m"""
    ),
    "kmer_counts": f"WITH {_SEQ}, {_rows(5, f'translate(s, {_translate(HP)})')} SELECT encoded, count(*) AS n FROM km GROUP BY 1",
    "canonical_kmers": """WITH seq AS (SELECT p_partkey AS key, regexp_replace(translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS s FROM part),
    km AS (SELECT substr(s, i, 4) AS kmer FROM (SELECT s, unnest(range(1, greatest(length(s) - 2, 1))) AS i FROM seq))
    SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS encoded, count(*) AS n FROM km GROUP BY 1""",
    "kmer_islands": f"WITH {_ISLANDS} SELECT name, first::INT AS first, last::INT AS last, n FROM island",
    "alignment_text": f"""WITH {_ISLANDS}, one AS (SELECT name, first, last, last - first + 4 AS length FROM island QUALIFY row_number() OVER (PARTITION BY name ORDER BY first) = 1),
    texts AS (SELECT name AS query, (a.key + 1)::VARCHAR AS match, first, length, a.s AS qs, b.s AS ms, translate(a.s, {_translate(HP)}) AS qe, translate(b.s, {_translate(HP)}) AS me FROM one JOIN seq a ON a.key::VARCHAR = name JOIN seq b ON b.key = a.key + 1),
    placed AS (SELECT *, instr(me, substr(qe, first + 1, 4)) - 1 AS mi FROM texts)
    SELECT query, match, substr(qs, first + 1, length) AS overlap, 'Match from ' || (first + 1) || '-' || (first + length) AS place,
      substr(qs, 1, first) || '[' || substr(qs, first + 1, length) || ']' || substr(qs, first + length + 1) AS shown,
      repeat(' ', greatest(mi - first, 0)) || qs || chr(10) || repeat(' ', greatest(mi - first, 0)) || qe || chr(10) || repeat(' ', greatest(first, mi)) || repeat('|', length) || chr(10) ||
      repeat(' ', greatest(first - mi, 0)) || me || chr(10) || repeat(' ', greatest(first - mi, 0)) || ms AS alignment FROM placed""",
    "kmer_stitch": f"WITH {_SEQ} SELECT key::VARCHAR AS name, s AS stitched FROM seq WHERE length(s) >= 4",
    "sketch_md5_of_sets": _with("SELECT key, md5('24' || string_agg(element::VARCHAR, '' ORDER BY element)) AS md5 FROM post GROUP BY 1"),
}
