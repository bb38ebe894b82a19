"""Registered queries of the annotation engine, each over lines rendered from `lineitem` and parsed again, with DuckDB SQL that works on the columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import gtf_attributes, lookup, token_id, word_id
from ..functions.numbers import six_digits
from ..operators import comparison, identifiers, select, statistics, transcripts
from ..sources import records as rec
from ..sources.sinks import record_text
from ..sources.workspace import own_path, store
from . import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_COLUMNS = """
  CAST(l_orderkey % 2 AS INT) + 1 AS src,
  'chr' || ((l_orderkey // 8) % 5 + 1) AS seqname,
  CASE WHEN l_orderkey % 11 = 0 THEN '.' WHEN (l_orderkey // 8) % 3 = 0 THEN '-' ELSE '+' END AS strand,
  CASE WHEN l_orderkey % 10 < 3 THEN 'T' || (l_orderkey % 2 + 1) || '_' ELSE 'T' END || (l_orderkey // 2) AS tx_id,
  CASE WHEN l_orderkey % 10 < 3 THEN 'G' || (l_orderkey % 2 + 1) || '_' ELSE 'G' END || (l_orderkey // 10) AS gene_id,
  CAST((l_orderkey // 8) * 10000 + l_linenumber * 1000 + 1 AS BIGINT) AS start,
  CAST((l_orderkey // 8) * 10000 + l_linenumber * 1000 + 300 AS BIGINT) AS "end",
  CAST(l_linenumber AS INT) AS slot
"""

_EXONS = f"ex AS (SELECT DISTINCT {_COLUMNS} FROM lineitem)"

_MIXED = f"""raw AS (SELECT {_COLUMNS}, l_returnflag AS flag, CAST(l_quantity AS INT) AS amount FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem)),
rec AS (SELECT *, 'src' || src AS source, CASE flag WHEN 'A' THEN 'exon' WHEN 'N' THEN 'CDS' ELSE 'gene' END AS feature,
  CASE WHEN slot % 3 = 0 THEN NULL ELSE CAST(amount + 0.5 AS FLOAT) END AS score, CASE WHEN slot % 2 = 0 THEN NULL ELSE slot % 3 END AS frame,
  CASE WHEN slot >= 4 THEN 'ID=' || tx_id || '-' || slot || ';Parent=' || tx_id || ';Is_circular;Note=a%20b=c'
       ELSE 'gene_id "' || gene_id || '"; transcript_id "' || tx_id || '"; exon_number ' || slot || ';' END AS attributes
  FROM raw WHERE slot <> 7)"""

_TX = f"""{_EXONS},
ord AS (SELECT *, lead(start) OVER (PARTITION BY src, tx_id ORDER BY start, "end") - 1 AS intron_end, "end" + 1 AS intron_start FROM ex),
tx AS (SELECT src, tx_id, min(seqname) AS seqname, min(strand) AS strand, min(gene_id) AS gene_id, min(start) AS start, max("end") AS "end", CAST(count(*) AS INT) AS n_exons, CAST(count(*) - 1 AS INT) AS n_introns FROM ex GROUP BY src, tx_id),
intr AS (SELECT src, tx_id, seqname, strand, intron_start AS start, intron_end AS "end" FROM ord WHERE intron_end IS NOT NULL)"""

_PAIRS = f"""{_TX},
pairs AS (SELECT a.seqname, a.strand, a.tx_id AS a_tx_id, a.start AS a_start, a."end" AS a_end, a.n_introns AS a_n_introns, b.tx_id AS b_tx_id, b.start AS b_start, b."end" AS b_end, b.n_introns AS b_n_introns,
  FROM tx a JOIN tx b ON a.src = 1 AND b.src = 2 AND a.seqname = b.seqname AND a.strand = b.strand AND a.start <= b."end" AND b.start <= a."end"),
common AS (SELECT i.tx_id AS a_tx_id, j.tx_id AS b_tx_id, count(*) AS n FROM intr i JOIN intr j ON i.src = 1 AND j.src = 2 AND i.seqname = j.seqname AND i.strand = j.strand AND i.start = j.start AND i."end" = j."end" GROUP BY ALL),
shared AS (SELECT p.*, CAST(coalesce(c.n, 0) AS INT) AS shared FROM pairs p LEFT JOIN common c USING (a_tx_id, b_tx_id)),
ranked AS (SELECT *, CASE WHEN a_n_introns > 0 AND shared = a_n_introns AND shared = b_n_introns THEN 3 WHEN shared > 0 THEN 2 ELSE 1 END AS rank FROM shared),
best AS (SELECT src, tx_id, max(rank) AS rank FROM (SELECT 1 AS src, a_tx_id AS tx_id, rank FROM ranked UNION ALL SELECT 2, b_tx_id, rank FROM ranked) GROUP BY ALL),
cls AS (SELECT t.*, ['u', 'o', 'j', '='][coalesce(b.rank, 0) + 1] AS cmp_class FROM tx t LEFT JOIN best b USING (src, tx_id)),
counts AS (SELECT src, count(*) AS n_tx, count(*) FILTER (cmp_class = '=') AS n_exact, count(*) FILTER (cmp_class = 'j') AS n_partial, count(*) FILTER (cmp_class = 'o') AS n_overlap, count(*) FILTER (cmp_class = 'u') AS n_unique FROM cls GROUP BY src)"""

_IDS = f"""{_EXONS},
genes AS (SELECT gene_id AS id, bool_or(src = 1) AS in_1, bool_or(src = 2) AS in_2 FROM ex GROUP BY gene_id),
txs AS (SELECT tx_id AS id, bool_or(src = 1) AS in_1, bool_or(src = 2) AS in_2 FROM ex GROUP BY tx_id)"""

REGION = "chr1:1-200000"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _exon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.records(fixture.exon_lines(spark, sf_dir))


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.exons_of(_exon_records(spark, sf_dir), "src")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.records(fixture.mixed_lines(spark, sf_dir))


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.build_transcripts(_exons(spark, sf_dir)).drop("reversed")


def _assembly(spark: SparkSession, sf_dir: str) -> transcripts.Assembly:
    return transcripts.assemble(_exons(spark, sf_dir))


def _introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.introns_of(store(_exons(spark, sf_dir), "exons"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.raw_records(fixture.exon_lines(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT src, seqname, source, feature, start, \"end\", score, strand, frame, attributes FROM rec")
def print_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("src", *rec.COLUMNS)


@query(f"WITH {_MIXED} SELECT count(*) FILTER (slot <> 7) AS parsed, count(*) FILTER (slot = 7 AND amount % 3 <> 1) AS skipped, count(*) FILTER (slot = 7 AND amount % 3 = 1) AS errors FROM raw")
def parse_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.diagnostics(fixture.mixed_lines(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT src, seqname, feature, start, \"end\", strand FROM rec WHERE feature = 'CDS'")
def filter_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.of_feature(_mixed(spark, sf_dir), "CDS").select("src", "seqname", "feature", "start", "end", "strand")


@query(f"WITH {_MIXED} SELECT count(*) FILTER (feature = 'CDS') AS matched, count(*) AS total FROM rec")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).agg(F.count_if(F.col("feature") == "CDS").alias("matched"), F.count("*").alias("total"))


@query(f"WITH {_MIXED} SELECT feature, count(*) AS n FROM rec GROUP BY feature")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.feature_counts(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT src, start, CASE WHEN slot < 4 THEN gene_id ELSE '.' END AS value FROM rec")
def attrs_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.attribute(_mixed(spark, sf_dir), "gene_id").select("src", "start", "value")


@query(f"WITH {_MIXED} SELECT src, start, CASE WHEN slot >= 4 THEN tx_id ELSE '.' END AS value FROM rec")
def attrs_gff3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.attribute(_mixed(spark, sf_dir), "Parent").select("src", "start", "value")


@query(f"WITH {_MIXED} SELECT CASE WHEN slot >= 4 THEN '' ELSE '.' END AS value, count(*) AS n FROM rec GROUP BY 1")
def attrs_missing_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.value_counts(_mixed(spark, sf_dir), "Is_circular")


@query(f"""WITH {_MIXED} SELECT src, start, place, key, value FROM (
 SELECT src, start, 0 AS place, 'gene_id' AS key, gene_id AS value FROM rec WHERE slot < 4 UNION ALL SELECT src, start, 1, 'transcript_id', tx_id FROM rec WHERE slot < 4
 UNION ALL SELECT src, start, 2, 'exon_number', CAST(slot AS VARCHAR) FROM rec WHERE slot < 4
 UNION ALL SELECT src, start, 0, 'ID', tx_id || '-' || slot FROM rec WHERE slot >= 4 UNION ALL SELECT src, start, 1, 'Parent', tx_id FROM rec WHERE slot >= 4
 UNION ALL SELECT src, start, 2, 'Is_circular', '' FROM rec WHERE slot >= 4 UNION ALL SELECT src, start, 3, 'Note', 'a%20b=c' FROM rec WHERE slot >= 4)""")
def attr_pairs_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.attribute_pairs(_mixed(spark, sf_dir)).select("src", "start", "place", "key", "value")


@query(f"WITH {_EXONS} SELECT gene_id AS value, count(*) AS n FROM ex GROUP BY 1")
def records_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.value_counts(_exon_records(spark, sf_dir), "gene_id", F.lit("gtf"))


@query(f"WITH {_EXONS} SELECT src, seqname, start, \"end\", strand FROM ex WHERE seqname = 'chr1' AND start <= 200000 AND \"end\" >= 1")
def overlap_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.overlapping(_exon_records(spark, sf_dir), REGION).select("src", "seqname", "start", "end", "strand")


@query(f"WITH {_EXONS} SELECT count(*) AS hits FROM ex WHERE seqname = 'chr1' AND start <= 200000 AND \"end\" >= 1")
def overlap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exon_records(spark, sf_dir).where(select.in_region(select.parse_region(REGION))).agg(F.count("*").alias("hits"))


def _region_set(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    return spark.range(40).select(n.cast("int").alias("region_id"), F.concat(F.lit("chr"), n % 5 + 1).alias("seqname"), (n * 70000 + 1).alias("start"), (n * 70000 + 9000).alias("end"))


@query(f"""WITH {_EXONS}, reg AS (SELECT CAST(n AS INT) AS region_id, 'chr' || (n % 5 + 1) AS seqname, n * 70000 + 1 AS s, n * 70000 + 9000 AS e FROM range(40) t(n))
 SELECT r.region_id, x.src, x.seqname, x.start, x."end" FROM ex x JOIN reg r ON x.seqname = r.seqname AND x.start <= r.e AND r.s <= x."end" """)
def overlap_region_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.overlapping_regions(_exon_records(spark, sf_dir), _region_set(spark)).select("region_id", "src", "seqname", "start", "end")


@query(ORACLES["overlap_region_set"])
def binned_region_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table stored by bins, of which only the bins that regions name are read."""
    path = own_path(spark, "binned")
    select.write_binned(_exon_records(spark, sf_dir).select("src", "seqname", "start", "end"), path)
    return select.regions_of_binned(spark, path, "src int, start long, end long", _region_set(spark)).select("region_id", "src", "seqname", "start", "end")


@query(f"WITH {_EXONS} SELECT seqname, start, \"end\", src, attributes, row_number() OVER (PARTITION BY seqname ORDER BY start, \"end\", src, attributes) AS rank FROM (SELECT *, 'gene_id \"' || gene_id || '\"; transcript_id \"' || tx_id || '\"; exon_number ' || slot || ';' AS attributes FROM ex)")
def sort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.position_rank(_exon_records(spark, sf_dir), "src", "attributes").select("seqname", "start", "end", "src", "attributes", "rank")


@query(f"WITH {_EXONS} SELECT src, seqname, strand, tx_id, gene_id, start, \"end\" FROM ex")
def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exons(spark, sf_dir)


@query(f"WITH {_EXONS} SELECT tx_id, min(gene_id) AS gene_id, count(*) AS exon_count FROM ex WHERE src = 1 GROUP BY tx_id")
def tx_exon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.transcript_exons(_exons(spark, sf_dir).where("src = 1"))


@query(f"WITH {_TX} SELECT * FROM tx")
def tx_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir)


@query(f"WITH {_TX} SELECT * FROM intr")
def tx_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _introns(spark, sf_dir)


@query(f"""WITH {_EXONS}, t AS (SELECT tx_id, min(gene_id) AS gene_id, count(*) AS c FROM ex WHERE src = 1 GROUP BY tx_id)
 SELECT gene_id, count(*) AS n_transcripts, CAST(sum(c) AS BIGINT) AS n_exons, max(c) = 1 AS single_exon, count(*) FILTER (c = 1) AS n_single FROM t GROUP BY gene_id""")
def gene_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.gene_rollup(_exons(spark, sf_dir).where("src = 1"))


@query(f"""WITH {_EXONS}, t AS (SELECT src, tx_id, min(gene_id) AS gene_id, count(*) AS c FROM ex GROUP BY src, tx_id), g AS (SELECT src, gene_id, max(c) AS m FROM t GROUP BY ALL),
 s AS (SELECT src, count(*) AS n_transcripts, CAST(sum(c) AS BIGINT) AS n_exons, CAST(sum(c - 1) AS BIGINT) AS n_introns, count(*) FILTER (c = 1) AS n_single_exon_transcripts FROM t GROUP BY src),
 h AS (SELECT src, count(*) AS n_genes, count(*) FILTER (m = 1) AS n_single_exon_genes FROM g GROUP BY src)
 SELECT src, n_genes, n_transcripts, n_exons, n_introns, n_single_exon_genes, n_single_exon_transcripts, CAST(n_exons AS DOUBLE) / n_genes AS mean_exons_per_gene, CAST(n_introns AS DOUBLE) / n_genes AS mean_introns_per_gene,
  CAST(100 AS DOUBLE) * n_single_exon_genes / n_genes AS pct_single_exon_genes, CAST(100 AS DOUBLE) * n_single_exon_transcripts / n_transcripts AS pct_single_exon_transcripts FROM s JOIN h USING (src)""")
def exon_intron_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.exon_intron_stats(_exons(spark, sf_dir), "src")


@query(f"WITH {_TX} SELECT DISTINCT src, seqname, strand, start, \"end\" FROM intr")
def introns_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.distinct_introns(_introns(spark, sf_dir))


_SHARE = f"""WITH {_TX}, d AS (SELECT seqname, strand, start, "end", max(CAST(src = 1 AS INT)) AS one, max(CAST(src = 2 AS INT)) AS two FROM intr GROUP BY ALL),
 s AS (SELECT count(*) FILTER (one = 1) AS n_introns_1, count(*) FILTER (two = 1) AS n_introns_2, count(*) FILTER (one = 1 AND two = 1) AS n_shared FROM d)"""


@query(f"{_SHARE} SELECT n_introns_1, n_introns_2, n_shared FROM s")
def introns_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.intron_counts(_introns(spark, sf_dir)).select("n_introns_1", "n_introns_2", "n_shared")


@query(f"{_SHARE} SELECT CAST(100 AS DOUBLE) * n_shared / n_introns_1 AS pct_shared_1, CAST(100 AS DOUBLE) * n_shared / n_introns_2 AS pct_shared_2 FROM s")
def intron_share_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.intron_counts(_introns(spark, sf_dir)).select("pct_shared_1", "pct_shared_2")


_LOCI = f"""WITH {_TX}, m AS (SELECT *, max("end") OVER (PARTITION BY seqname, strand ORDER BY start, "end", src, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tx),
 l AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY seqname, strand ORDER BY start, "end", src, tx_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS locus FROM m)"""


@query(f"{_LOCI} SELECT src, tx_id, seqname, strand, start, \"end\", locus FROM l")
def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.assign_locus(store(_tx(spark, sf_dir), "transcripts")).select("src", "tx_id", "seqname", "strand", "start", "end", "locus")


@query(f"{_LOCI} SELECT seqname, strand, locus, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n_tx FROM l GROUP BY seqname, strand, locus")
def locus_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.assign_locus(store(_tx(spark, sf_dir), "transcripts")).groupBy("seqname", "strand", "locus").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tx"))


@query(f"WITH {_PAIRS} SELECT seqname, strand, a_tx_id, b_tx_id, a_start, a_end, b_start, b_end FROM pairs")
def tx_pairs_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.overlapping_pairs(store(_tx(spark, sf_dir), "transcripts")).select("seqname", "strand", "a_tx_id", "b_tx_id", "a_start", "a_end", "b_start", "b_end")


@query(f"WITH {_PAIRS} SELECT a_tx_id, b_tx_id, shared FROM shared")
def tx_pairs_shared_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _assembly(spark, sf_dir)
    return comparison.with_shared(comparison.overlapping_pairs(both.tx), both.introns).select("a_tx_id", "b_tx_id", "shared")


@query(f"WITH {_PAIRS} SELECT a_tx_id, b_tx_id, ['u', 'o', 'j', '='][rank + 1] AS pair_class FROM ranked")
def tx_pair_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _assembly(spark, sf_dir)
    return comparison.pair_class(comparison.with_shared(comparison.overlapping_pairs(both.tx), both.introns)).select("a_tx_id", "b_tx_id", "pair_class")


@query(f"WITH {_PAIRS} SELECT src, tx_id, cmp_class FROM cls")
def tx_best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.classify(_assembly(spark, sf_dir)).select("src", "tx_id", "cmp_class")


@query(f"WITH {_PAIRS} SELECT * FROM counts")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.class_counts(comparison.classify(_assembly(spark, sf_dir)))


@query(f"""WITH {_PAIRS} SELECT src, CAST(100 AS DOUBLE) * n_exact / n_tx AS pct_exact, CAST(100 AS DOUBLE) * n_partial / n_tx AS pct_partial,
 CAST(100 AS DOUBLE) * n_overlap / n_tx AS pct_overlap, CAST(100 AS DOUBLE) * n_unique / n_tx AS pct_unique FROM counts""")
def class_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.class_percentages(comparison.classify(_assembly(spark, sf_dir)))


@query(f"""WITH {_PAIRS} SELECT max(CASE WHEN src = 1 THEN CAST(100 AS DOUBLE) * n_exact / n_tx END) AS sensitivity, max(CASE WHEN src = 2 THEN CAST(100 AS DOUBLE) * n_exact / n_tx END) AS precision FROM counts""")
def sens_prec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.sensitivity_precision(comparison.classify(_assembly(spark, sf_dir)))


@query(f"WITH {_IDS} SELECT id FROM genes WHERE in_1 AND in_2")
def gene_ids_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.shared_ids(_raw(spark, sf_dir), "gene_id")


@query(f"WITH {_IDS} SELECT id FROM genes WHERE in_1 AND NOT in_2")
def gene_ids_only1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.ids_only_in(_raw(spark, sf_dir), "gene_id", 1)


@query(f"WITH {_IDS} SELECT id FROM genes WHERE in_2 AND NOT in_1")
def gene_ids_only2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.ids_only_in(_raw(spark, sf_dir), "gene_id", 2)


@query(f"WITH {_IDS} SELECT id FROM txs WHERE in_1 AND in_2")
def tx_ids_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.shared_ids(_raw(spark, sf_dir), "transcript_id")


_SUM = f"""WITH {_IDS}, s AS (SELECT 'gene' AS level, count(*) FILTER (in_1) AS n1, count(*) FILTER (in_2) AS n2, count(*) FILTER (in_1 AND in_2) AS shared, count(*) FILTER (in_1 AND NOT in_2) AS only1, count(*) FILTER (in_2 AND NOT in_1) AS only2 FROM genes
 UNION ALL SELECT 'transcript', count(*) FILTER (in_1), count(*) FILTER (in_2), count(*) FILTER (in_1 AND in_2), count(*) FILTER (in_1 AND NOT in_2), count(*) FILTER (in_2 AND NOT in_1) FROM txs)"""


@query(f"{_SUM} SELECT * FROM s")
def id_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.summary(_raw(spark, sf_dir))


@query(f"{_SUM} SELECT level, only1, only2, shared FROM s")
def venn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.summary(_raw(spark, sf_dir)).select("level", "only1", "only2", "shared")


_RECORD = "src, gene_id, tx_id AS transcript_id, seqname || chr(9) || 'src' || src || chr(9) || 'exon' || chr(9) || start || chr(9) || \"end\" || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id \"' || gene_id || '\"; transcript_id \"' || tx_id || '\"; exon_number ' || slot || ';' AS value"


@query(f"WITH {_IDS} SELECT {_RECORD} FROM ex WHERE src = 1 AND gene_id NOT IN (SELECT id FROM genes WHERE in_2)")
def records_only_in_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.records_only_in(_raw(spark, sf_dir), 1)


@query(f"WITH {_IDS} SELECT {_RECORD} FROM ex WHERE src = 2 AND gene_id NOT IN (SELECT id FROM genes WHERE in_1)")
def records_only_in_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.records_only_in(_raw(spark, sf_dir), 2)


@query(f"WITH {_IDS} SELECT {_RECORD} FROM ex WHERE src = 1 OR gene_id NOT IN (SELECT id FROM genes WHERE in_1)")
def records_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.merge(_raw(spark, sf_dir))


@query(f"""WITH {_MIXED} SELECT src, seqname || chr(9) || source || chr(9) || feature || chr(9) || start || chr(9) || "end" || chr(9) || coalesce((amount || '.5'), '.') || chr(9) || strand || chr(9) || coalesce(CAST(frame AS VARCHAR), '.') || chr(9) || attributes AS value
 FROM (SELECT * REPLACE (CASE WHEN slot % 3 = 0 THEN NULL ELSE amount END AS amount) FROM rec)""")
def format_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("src", record_text(six_digits("score")).alias("value"))


#: Lines that the parser must not read as they look, made from the orders: what each has at fault goes by the order's number.
_EDGE = """edge AS (SELECT o, CAST(o % 7 AS INT) AS fault, 'g' || o AS g FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem))"""


@query(f"""WITH {_EDGE} SELECT o, CASE fault WHEN 0 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'skipped' ELSE 'record' END AS line_kind,
 CASE fault WHEN 1 THEN o WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 9223372036854775807 END AS start, CASE fault WHEN 1 THEN -o WHEN 2 THEN 7 WHEN 5 THEN o WHEN 6 THEN -9223372036854775808 END AS "end",
 CASE fault WHEN 1 THEN '.' WHEN 2 THEN '1.23457e+06' WHEN 5 THEN '0.5' WHEN 6 THEN 'inf' END AS score, CASE fault WHEN 1 THEN '+' WHEN 2 THEN '.' WHEN 5 THEN '-' WHEN 6 THEN '+' END AS strand,
 CAST(CASE fault WHEN 2 THEN 2 WHEN 6 THEN -1294967296 END AS INT) AS frame, CASE fault WHEN 1 THEN g WHEN 2 THEN g WHEN 5 THEN 'Y' WHEN 6 THEN '' END AS list_gene,
 CASE fault WHEN 1 THEN g WHEN 2 THEN 'x' WHEN 5 THEN 'Y' WHEN 6 THEN '' END AS token_gene, CASE fault WHEN 0 THEN g WHEN 2 THEN 'x' WHEN 5 THEN g WHEN 6 THEN '""' END AS word_gene FROM edge""")
def parse_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields, numbers with a tail or too large, points, junk after a strand, nested quotes, carriage returns, comments."""
    o = F.col("l_orderkey")
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(o.alias("o")).distinct()
    text = {
        0: 'chr1\t\texon\t%s\t9\t.\t+\t.\tgene_id "g%s";',
        1: 'chr1\tx\texon\t%sabc\t-%s\t.5\t+x\t-1\tgene_id  "g%s";\textra',
        2: 'chr1\tx\texon\tabc\t7\t1234567\t.\t2x\tnote "a; gene_id "x"; gene_id "g%s";',
        3: " # %s",
        4: "#c%s",
        5: 'chr1\tx\texon\t1\t%s\t0.50\t-\t.\tref-gene_id "g%s"; gene_id "Y"\r',
        6: 'chr1\tx\texon\t%s99999999999999999999\t-99999999999999999999\tinf\t+\t3000000000\tgene_id "";',
    }
    value = F.lit(None).cast("string")
    for fault, line in text.items():
        value = F.when(F.col("o") % 7 == fault, F.format_string(line, *[F.col("o").cast("string")] * line.count("%s"))).otherwise(value)
    parsed = rec.parse_lines(own.withColumn("value", value))
    a, is_record = F.col("attributes"), F.col("line_kind") == "record"
    ninth = F.get(F.split("value", "\t"), F.lit(8))
    return parsed.select("o", "line_kind", "start", "end", F.when(is_record, F.coalesce(six_digits("score"), F.lit("."))).alias("score"), "strand", "frame", lookup(gtf_attributes(a), "gene_id").alias("list_gene"), F.when(is_record, token_id(a, "gene_id")).alias("token_gene"), word_id(ninth, "gene_id").alias("word_gene"))


@query(f"""WITH {_EDGE} SELECT o, CASE fault WHEN 0 THEN 'chr' || o WHEN 1 THEN 'chr1:alt' || o WHEN 2 THEN 'c' END AS seqname, CASE fault WHEN 0 THEN o WHEN 1 THEN 5 WHEN 2 THEN -o END AS start,
 CASE fault WHEN 0 THEN o + 9 WHEN 1 THEN 9 WHEN 2 THEN o END AS "end" FROM edge""")
def region_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions from a column of texts: split at the last colon, junk after the second number, signs and blanks; null for what is none."""
    o = F.col("l_orderkey").cast("string")
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), o.alias("t")).distinct()
    c = lambda *parts: F.concat(*[F.col("t") if p is None else F.lit(p) for p in parts])
    kinds = [F.concat(F.lit("chr"), "t", F.lit(":"), "t", F.lit("-"), (F.col("o") + 9).cast("string")), c("chr1:alt", None, ":5-9xyz"), c("c: -", None, "-  +", None), c("c", None), c("chr1:1,", None, "-2,000"), c(":1-", None), c("c:", None, "-0")]
    text = F.array(*kinds)[(F.col("o") % 7).cast("int")]
    return own.withColumn("region", select.region_columns(text)).select("o", "region.*")
