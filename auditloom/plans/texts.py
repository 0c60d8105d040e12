"""Queries of the jobs over texts, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.fixtures import view
from auditloom.operators import texts as tx
from auditloom.registry import Registry

#: Each turn is a run of its conversation: it brings its longest word, its first three words and its own name, and every fifth turn
#: speaks of a comparison and repeats the name of the turn before.
RUNS = """SELECT conv_id AS log, turn AS sequence, concat('run-', CAST(conv_id AS {s}), '-', CAST(turn AS {s})) AS run_id,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN concat(text, ' Compare  it with run-', CAST(conv_id AS {s}), '-', CAST(turn - 1 AS {s}), ' before') ELSE text END AS text, text AS own FROM {t}"""
#: Truths with parts of a document's own text at two places.
TRUTHS = "SELECT doc_id AS case_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat(substring(text, 3, 14), '#', substring(text, 150, 14)) END AS truth FROM {}"
#: Names of suppliers written in three ways.
NAMES = "SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('Château ', s_nationkey, ' – Éclat') WHEN 1 THEN concat('CHATEAU  ', s_nationkey, ' eclat') ELSE concat('chateau-', s_nationkey, '''Eclàt') END AS text FROM {}"
#: Prompts of a run in three components of few different texts.
PRINTS = "SELECT s_suppkey AS run_id, concat('a', CAST(s_suppkey % 2 AS {s})) AS a, concat('b', CAST(s_suppkey % 7 AS {s})) AS b, CASE WHEN s_suppkey % 11 > 0 THEN concat('c', CAST(s_nationkey AS {s})) END AS c FROM {t}"
LINES = """SELECT 'a' AS component, concat('a', CAST(k AS {s})) AS digest, concat('Look at the label.', chr(10), '  Rule ', CAST(k AS {s}), ' ', chr(10), chr(10), 'Answer in JSON.') AS text FROM (SELECT DISTINCT s_suppkey % 2 AS k FROM {t})
  UNION ALL SELECT 'b', concat('b', CAST(k AS {s})), concat('Say what you see', chr(10), 'part ', CAST(k % 3 AS {s}), chr(10), 'part ', CAST(k % 3 AS {s})) FROM (SELECT DISTINCT s_suppkey % 7 AS k FROM {t})
  UNION ALL SELECT 'c', concat('c', CAST(k AS {s})), concat('[', chr(10), '"nation" ', CAST(k AS {s}), chr(10), ']') FROM (SELECT DISTINCT s_nationkey AS k FROM {t})"""
FOLD = "upper(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"

SIGNALS = f"""WITH r AS ({RUNS.format(s='VARCHAR', t='conversations')}), w AS (SELECT *, string_split(own, ' ') AS w FROM r),
  b AS (SELECT log, sequence, run_id, 'word' AS kind, unnest(list_filter(w, lambda x: length(x) >= 11)) AS token FROM w UNION ALL SELECT log, sequence, run_id, 'opening', array_to_string(w[1:3], ' ') FROM w UNION ALL SELECT log, sequence, run_id, 'name', run_id FROM w),
  brought AS (SELECT DISTINCT log, sequence, run_id, kind, {FOLD.format('token')} AS token FROM b), f AS (SELECT log, kind, token, min(sequence) AS first_sequence FROM brought WHERE token <> '' GROUP BY ALL),
  t AS (SELECT log, sequence, run_id, {FOLD.format('text')} AS body FROM r)
  SELECT DISTINCT t.log, t.sequence, t.run_id, f.kind, f.token, f.first_sequence FROM t JOIN f ON f.log = t.log AND f.first_sequence < t.sequence AND contains(t.body, f.token)
    WHERE NOT EXISTS (SELECT 1 FROM brought o WHERE o.log = t.log AND o.sequence = t.sequence AND o.run_id = t.run_id AND o.kind = f.kind AND o.token = f.token)
  UNION ALL SELECT DISTINCT log, sequence, run_id, 'comparison', unnest(list_filter(['PREVIOUS', 'BEFORE', 'COMPARE', 'COMPARISON'], lambda x: regexp_matches(body, '\\b' || x || '\\b'))), NULL FROM t"""
PARTS = f"""WITH t AS (SELECT case_id, coalesce(truth, '') AS truth FROM ({TRUTHS.format('documents')})), l AS (SELECT doc_id AS case_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
  c AS (SELECT case_id, truth, a, n, truth[a:a + n - 1] AS part FROM t, range(1, 31) AS s(a), range(5, 31) AS z(n) WHERE a + n - 1 <= length(truth)),
  h AS (SELECT c.case_id, n, line, a, part FROM c JOIN l ON l.case_id = c.case_id AND contains(l.text, c.part)), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, line, a) = 1)
  SELECT t.case_id, CAST(length(truth) AS INT) AS truth_length, CAST(line AS INT) AS line, coalesce(part, '') AS part, CAST(coalesce(n, 0) AS INT) AS length FROM t LEFT JOIN b ON b.case_id = t.case_id"""
ONE_SIDED = f"""WITH p AS ({PRINTS.format(s='VARCHAR', t='supplier')}), k AS (SELECT min(run_id) AS class_id, a, b, c FROM p GROUP BY a, b, c), e AS (SELECT class_id, 'a' AS component, a AS digest FROM k UNION ALL SELECT class_id, 'b', b FROM k UNION ALL SELECT class_id, 'c', c FROM k),
  l AS (SELECT DISTINCT component, digest, trim(unnest(string_split(text, chr(10)))) AS line FROM ({LINES.format(s='VARCHAR', t='supplier')})),
  h AS (SELECT class_id, e.component, e.digest, line FROM e JOIN l ON l.component = e.component AND l.digest = e.digest WHERE line <> ''), n AS (SELECT component, line, count(*) AS classes FROM h GROUP BY ALL), m AS (SELECT component, count(*) AS total FROM e WHERE digest IS NOT NULL GROUP BY 1)
  SELECT h.component, class_id, digest, h.line, classes, total - classes AS others FROM h JOIN n ON n.component = h.component AND n.line = h.line JOIN m ON m.component = h.component WHERE classes < total"""
VARIANTS = f"""WITH t AS ({NAMES.format('supplier')}), k AS (SELECT text, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM t GROUP BY 1)
  SELECT key, CAST(sum(n) AS BIGINT) AS n, count(*) AS variants, array_to_string(list(text ORDER BY n DESC, encode(text))[1:5], '|') AS samples FROM k GROUP BY 1"""


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns of a conversation repeat of earlier ones."""
    # the SQL's concat leaves nulls out, and a turn without text has a name
    runs = spark.sql(RUNS.replace("concat(", "concat_ws('', ").format(s="STRING", t="{t}"), t=view(spark, sf_dir, "conversations"))
    w = F.split(F.coalesce("own", F.lit("")), " ")
    token = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("token"))
    tokens = F.concat(F.transform(F.filter(w, lambda x: F.length(x) >= 11), lambda x: token("word", x)), F.array(token("opening", F.array_join(F.slice(w, 1, 3), " ")), token("name", F.col("run_id"))))
    return tx.run_signals(runs.withColumn("tokens", tokens))


def register(r: Registry) -> None:
    """Adds the queries of this module."""
    lines = lambda s, d: view(s, d, "documents").select(F.col("doc_id").alias("case_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    sql = lambda s, text, **tables: s.sql(text.format(s="STRING", **{k: f"{{{k}}}" for k in tables}), **tables)
    r.add("j16_run_signals", SIGNALS)(signalled)
    r.add("j17_common_parts", PARTS)(lambda s, d: tx.common_parts(lines(s, d), s.sql(TRUTHS.format("{t}"), t=view(s, d, "documents"))))
    r.add("j24_class_lines", ONE_SIDED)(lambda s, d: tx.class_lines(sql(s, PRINTS, t=view(s, d, "supplier")), sql(s, LINES, t=view(s, d, "supplier")), ["a", "b", "c"]))
    r.add("x21_compact_keys", VARIANTS)(lambda s, d: tx.key_variants(s.sql(NAMES.format("{t}"), t=view(s, d, "supplier")), tx.compact("text")))
