"""DuckDB's SQL for the queries of files: what went in is what comes out."""

from __future__ import annotations

from hitlens.functions.alphabets import DAYHOFF, HP
from hitlens.plans.adapters import SCORES
from hitlens.plans.oracles import _SEQ, _kmers, _levels_long, _long, _rows, _thresholds, _translate, _with
from hitlens.schema import HITS, SAME

_M = "18446744073709551616::UHUGEINT"


def _mul(x, factor):
    return f"(({x})::UHUGEINT * {factor}::UHUGEINT % {_M})::UBIGINT"


def _murmur(source, text):
    """source with hash: MurmurHash3 x64-128 (low word, seed 42) of ASCII texts of up to 8 letters."""
    word = f"list_sum(list_transform(range(1, length({text}) + 1), lambda i: (ord(substr({text}, i, 1)) * power(256, i - 1)::UBIGINT)::UHUGEINT))::UBIGINT"
    steps = [
        [("k0", word)],
        [("k1", _mul("k0", 9782798678568883157))],
        [("k2", f"(k1::UHUGEINT * 2147483648::UHUGEINT % {_M} + (k1 >> 33))::UBIGINT")],
        [("k3", _mul("k2", 5545529020109919103))],
        [("a0", f"xor(xor(42::UBIGINT, k3), length({text})::UBIGINT)"), ("b0", f"xor(42::UBIGINT, length({text})::UBIGINT)")],
        [("a1", f"((a0::UHUGEINT + b0) % {_M})::UBIGINT")],
        [("b1", f"((b0::UHUGEINT + a1) % {_M})::UBIGINT")],
    ]
    for i, factor in ((2, 18397679294719823053), (4, 14181476777654086739), (6, None)):
        steps.append([(f"{v}{i}", f"xor({v}{i - 1}, {v}{i - 1} >> 33)") for v in "ab"])
        if factor:
            steps.append([(f"{v}{i + 1}", _mul(f"{v}{i}", factor)) for v in "ab"])
    steps.append([("hash", f"((a6::UHUGEINT + b6) % {_M})::UBIGINT")])
    out = source
    for step in steps:
        out = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step)} FROM ({out})"
    return out


_HP = f"translate(s, {_translate(HP)})"
_TYPE = f"translate(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), {_translate(HP)})"
_WANTED = f"wanted AS (SELECT DISTINCT unnest({_kmers('t', 6)}) AS encoded FROM (SELECT DISTINCT {_TYPE} AS t FROM part))"
_MATCHED = f"WITH {_SEQ}, {_rows(6, _HP)}, {_WANTED}, hashed AS ({_murmur('SELECT encoded FROM wanted', 'encoded')}), found AS (SELECT km.*, hash FROM km JOIN hashed USING (encoded))"
_MINS = f"hashed AS ({_murmur('SELECT DISTINCT encoded FROM km', 'encoded')}), sketch AS (SELECT key, count(*) AS n, min(hash) AS least, md5('15' || string_agg(hash::VARCHAR, '' ORDER BY hash)) AS md5 FROM (SELECT DISTINCT key, encoded FROM km) JOIN hashed USING (encoded) GROUP BY 1)"
_ALL_SCORES = _thresholds(f"SELECT score_name, scop_level, is_same::INT AS y, score_value AS s FROM ({_levels_long(_long(SCORES))})", ["score_name", "scop_level"])


def _named(table):
    t = table[0]
    text = f"upper(regexp_replace({t}_name, '[^A-Za-z]', '', 'g'))"
    return f"SELECT name, i - 1 AS start, substr(s, i, 3) AS kmer, translate(substr(s, i, 3), {_translate(DAYHOFF)}) AS encoded FROM (SELECT {t}_name AS name, {text} AS s, unnest(range(1, greatest(length({text}) - 1, 1))) AS i FROM {table})"


ORACLES = {
    "csv_round_trip": "SELECT * FROM supplier",
    "tsv_scan": "SELECT * FROM nation",
    "text_lines": "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation",
    "csv_transcoded": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "headerless_lookup": _with("SELECT name, split_part(name, ' ', 1) AS scop_id, split_part(name, ' ', 2) AS lineage FROM ent"),
    "declared_schema_scan": _with(f"SELECT query_name, count(*) AS n, round(sum(jaccard), 7) AS jaccard, 0 AS known, {len(HITS)} AS columns FROM hit GROUP BY 1"),
    "glob_scan": "SELECT c_custkey, c_acctbal FROM customer",
    "file_list_scan": "SELECT * FROM region UNION ALL SELECT * FROM region UNION ALL SELECT * FROM region",
    "limited_scan": "SELECT least(count(*), 10) AS n FROM customer",
    "schema_only": "SELECT column_name AS name FROM (DESCRIBE lineitem)",
    "partitioned_sweep": "SELECT p_partkey, lower(p_brand) AS moltype, p_size AS ksize FROM part WHERE right(p_brand, 1) IN ('1', '2', '3') AND p_size BETWEEN 5 AND 20",
    "named_sweep": " UNION ALL ".join(f"SELECT n_nationkey, n_name, '{m}' AS moltype, {k} AS ksize FROM nation" for m, k in (("hp", 8), ("hp", 9), ("dayhoff", 8))),
    "skipped_existing": "SELECT * FROM region",
    "row_group_sizes": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS bounded FROM orders",
    "literal_rows": "SELECT * FROM (VALUES ('ced9', 2, 3, 2), ('ced9', 3, 2, 2), ('bcl2', 2, 3, 3), ('bcl2', 3, 2, 2)) v(name, k, n_kmers, n_unique)",
    "fasta_round_trip": f"WITH {_SEQ} SELECT key::VARCHAR AS name, s AS sequence FROM seq",
    "fasta_residues": f"WITH {_SEQ} SELECT count(*) AS records, sum(length(s))::BIGINT AS residues FROM seq",
    "signature_round_trip": f"WITH {_SEQ}, {_rows(5, _HP)}, {_MINS} SELECT key::VARCHAR AS name, 'parts.fasta' AS filename, 15 AS ksize, 'hp' AS molecule, md5 AS md5sum, n, least::VARCHAR AS least FROM sketch",
    "kmer_murmur_sketch": f"WITH {_SEQ}, {_rows(5, _HP)}, {_MINS} SELECT key::VARCHAR AS name, n, md5 FROM sketch",
    "kmer_matches": f"{_MATCHED} SELECT kmer AS kmer_in_sequence, encoded AS kmer_in_alphabet, hash::VARCHAR AS hashval, start, key::VARCHAR AS read_name FROM found",
    "annotated_records": f"{_MATCHED} SELECT key || '|hashval:' || hash || '|kmer:' || kmer || '|kmer_encoded:' || encoded AS name, s AS sequence FROM found JOIN seq USING (key)",
    "first_match_of_a_read": f"WITH {_SEQ}, {_rows(6, _HP)}, {_WANTED} SELECT key::VARCHAR AS read_name, min(start) AS start, arg_min(kmer, start) AS kmer_in_sequence FROM km JOIN wanted USING (encoded) GROUP BY 1",
    "merged_kmers": f"SELECT encoded, a.name AS name_x, a.start AS start_x, a.kmer AS kmer_x, b.name AS name_y, b.start AS start_y, b.kmer AS kmer_y FROM ({_named('nation')}) a JOIN ({_named('region')}) b USING (encoded)",
    "hits_with_objects": f"WITH {_SEQ}, {_rows(5, _HP)}, n AS (SELECT key, count(DISTINCT encoded) AS n FROM km GROUP BY 1) SELECT key::VARCHAR AS query, (key + 1)::VARCHAR AS match, n, b.s AS sequence FROM n JOIN (SELECT key - 1 AS key, s FROM seq) b USING (key)",
    "codon_ksizes": "SELECT k AS ksize, k // 3 AS letters, k AS untranslated FROM range(15, 61, 3) t(k)",
    "columns_by_type": "SELECT unnest([" + ", ".join(f"'{f.name}'" for f in HITS if f.dataType.simpleString() == "double") + "]) AS name",
    "first_column_order": "SELECT * FROM (VALUES (0, 'p_size'), (1, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_retailprice')) v(place, name)",
    "verified_overlaps": f"WITH {_SEQ} SELECT key::VARCHAR AS name, substr(s, 2, 5) AS overlap FROM seq",
    "incremental_clean": _with("SELECT query_scop_id, count(*) AS n, " + ", ".join(f"sum({s}::INT)::BIGINT AS {s}" for s in SAME) + " FROM clean GROUP BY 1"),
    "metric_table": _with(
        """SELECT score_name, scop_level, 'average_precision' AS metric, round(sum(pos / p * tp / (tp + fp)), 7) AS value FROM t GROUP BY ALL
        UNION ALL SELECT score_name, scop_level, 'roc_auc', round(sum(neg / n * (tp - pos / 2) / p), 7) FROM t GROUP BY ALL
        UNION ALL SELECT score_name, scop_level, 'prevalence', round(any_value(p) / (any_value(p) + any_value(n)), 7) FROM t GROUP BY ALL""",
        _ALL_SCORES,
    ),
    "column_summary": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS sd, min({c}) AS least, max({c}) AS most FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "mean_intervals": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS low, round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS high FROM orders GROUP BY 1",
    "cumulative_density": "SELECT l_returnflag, l_quantity, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag), 9) AS share FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "per_group_function": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1",
}
