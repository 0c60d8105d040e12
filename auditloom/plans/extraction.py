"""Queries of the extraction jobs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.fixtures import duck, view
from auditloom.functions import text as tx
from auditloom.operators import extraction as ex
from auditloom.operators.dealing import dealt
from auditloom.registry import Registry

WORDS = """words AS (SELECT case_id, ix AS word_ix, text, CAST(40 * (ix % 8) AS DOUBLE) AS x0, CAST(28 * (ix // 8) + (length(text) + ix) % 7 AS DOUBLE) AS y0, CAST(40 * (ix % 8) + 8 * length(text) AS DOUBLE) AS x1,
  CAST(28 * (ix // 8) + (length(text) + ix) % 7 + 16 + ix % 5 AS DOUBLE) AS y1, CASE WHEN ix % 17 <> 0 THEN CAST(40 + (7 * length(text) + 13 * ix) % 61 AS INT) END AS raw_confidence
  FROM (SELECT doc_id AS case_id, unnest(w) AS text, CAST(generate_subscripts(w, 1) - 1 AS INT) AS ix FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS w FROM documents)))"""
PASSES = "SELECT doc_id AS case_id, CAST(doc_id % 4 * 90 AS INT) AS rotate, CAST(doc_id % 3 + 1 AS INT) AS scale, CAST(doc_id % 7 * 10 AS INT) AS crop_x, CAST(doc_id % 5 * 10 AS INT) AS crop_y, 600 AS w, 4000 AS h FROM {}"
LINED = "lined AS (SELECT case_id, word_ix // 8 AS line, word_ix AS ix, text FROM words)"
CASES = """SELECT l_orderkey * 10 + l_linenumber AS case_id, l_suppkey % 9 <> 0 AS sufficient, CASE l_partkey % 4 WHEN 0 THEN 'NOT_OBSERVED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS state, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE concat('ALC. ', CAST(CAST(l_quantity AS INT) AS {s}), CASE WHEN l_linenumber % 3 = 0 THEN '% BY VOL.' WHEN l_linenumber % 3 = 1 THEN ' % alc/vol' ELSE '% vol' END) END AS statement,
  CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE concat(CAST(CAST(l_quantity AS INT) + l_linenumber % 2 AS {s}), '.0%') END AS declared, CASE WHEN l_partkey % 5 <> 0 THEN concat('Brand ', CAST(l_partkey % 3 AS {s}), CASE WHEN l_linenumber % 2 = 0 THEN ', Inc.' ELSE '' END) END AS brand, concat('BRAND  ', CAST(l_suppkey % 3 AS {s})) AS declared_brand FROM {t}"""
#: Windows as they are read from pictures, {q} a number, with what they state: kind, low, high, reason, operations.
WINDOWS = [
    ("{q}% by vol", "direct", "100 * q", "100 * q", "explicit-percent-by-volume", ""), ("ALC{q}% BY VOL.", "direct", "100 * q", "100 * q", "explicit-percent-alc-vol", "text-repaired"),
    ("ALC % {q},5 BY VOL", "direct", "100 * q + 50", "100 * q + 50", "explicit-percent-alc-vol", "text-repaired,percent-before-number-reordered"), ("{q}.5% alc./vol.", "direct", "100 * q + 50", "100 * q + 50", "explicit-percent-alc-vol", ""),
    ("alcohol {q} by volume", "direct", "100 * q", "100 * q", "explicit-percentless-alcohol-by-volume", ""), ("ALC {q} VOL", "direct", "100 * q", "100 * q", "explicit-percentless-alcohol-by-volume", ""), ("{q}% abv", "direct", "100 * q", "100 * q", "explicit-percent-by-volume", "text-repaired"),
    ("{q}% to 6{d}% by vol", "range", "100 * q", "6000 + 100 * (q % 10)", "explicit-percent-by-volume", ""), ("6{d}-{q}% by vol", "rejected", None, None, "unsupported-pattern", None), ("none by vol", "rejected", None, None, "no-supported-number", None),
    ("{q} proof", "rejected", None, None, "proof-only", None), ("{q}%", "rejected", None, None, "missing-volume-marker", None), ("{q} by vol", "rejected", None, None, "missing-explicit-alcohol-marker", None), ("{q}% vol", "rejected", None, None, "bare-volume-marker-too-weak", None),
    ("about {q}% by vol", "rejected", None, None, "unsupported-pattern", None), ("a1c. I{d}% by v0l", "direct", "1000 + 100 * (q % 10)", "1000 + 100 * (q % 10)", "explicit-percent-alc-vol", "text-repaired"),
]
READ = "SELECT l_orderkey AS case_id, l_linenumber AS line, CAST(l_partkey % 16 AS INT) AS t, CAST(l_quantity AS INT) AS q FROM {}"
#: Lines, and what each is taken for.
LINES = [
    ("Bottled by Oak Hill", "producer-line"), ("12 %", "no-letters-or-too-short"), ("CONTAINS SULFITES", "non-brand-keyword"), ("One Two Three Four Five", "too-many-words"), ("ACME.COM", "domain-like"), ("Pinot Noir", "varietal-or-designation"), ("American Red Vino", "generic-product-language"),
    ("Napa Valley", "location-or-appellation"), ("Ab C", "low-information-fragment"), ("made for slow days", "sentence-fragment"), ("Oak Hill Cellars", "candidate-positive"), ("Smith's", "candidate-positive"), ("Golden Fork", "candidate-plausible"), ("SURGEONGENERAL X", "non-brand-keyword"), ("Rioja, Spain", "location-or-appellation"), ("Golden Fork,", "sentence-fragment"),
]
#: Candidates: text, key, whether it is positive, letters and digits of lettered tokens, informative tokens, lettered tokens, short ones, words, odd words.
NAMED = [
    ("RIVER OAK ESTATE", "riveroakestate", True, 14, 3, 3, 0, 3, 0), ("Smith's", "smiths", True, 6, 1, 1, 0, 1, 0), ("to be Found", "tobefound", False, 9, 1, 3, 2, 3, 2), ("Blue 2019 Hill", "blue2019hill", False, 8, 3, 2, 0, 3, 1), ("& Sons Cellars", "sonscellars", True, 11, 2, 2, 0, 3, 1), ("the Mill", "themill", False, 7, 2, 2, 0, 2, 0),
]
NAMES = """SELECT l_orderkey AS case_id, l_linenumber AS id, CAST(floor((l_linenumber + 1) / 2) AS INT) AS line, CAST(min(l_partkey) % 6 AS INT) AS t, CAST(min(l_partkey) % 500 AS DOUBLE) AS x, CAST(l_linenumber * 40 + min(l_suppkey) % 7 AS DOUBLE) AS y, CAST(60 + min(CAST(l_quantity AS INT)) * 4 AS DOUBLE) AS width,
  CAST(12 + min(l_suppkey) % 30 AS DOUBLE) AS height, CAST(40 + min(l_partkey) % 60 AS DOUBLE) / 100 AS evidence, min(l_returnflag) AS pass_id FROM {} GROUP BY l_orderkey, l_linenumber"""
DUCK_NAMES = "n AS (SELECT * FROM ({}) b JOIN (VALUES {}) v(t, text, key, positive, chars, informative, alpha, short, words, odd) ON v.t = b.t)".format(NAMES.format("lineitem"), ", ".join(f"({i}, '{x[0].replace(chr(39), chr(39) * 2)}', '{x[1]}', {str(x[2]).lower()}, {', '.join(map(str, x[3:]))})" for i, x in enumerate(NAMED)))
DUCK_SCORED = """f AS (SELECT *, max(height) OVER c AS top, max(width * height) OVER c AS most FROM n WINDOW c AS (PARTITION BY case_id)),
  g AS (SELECT *, CASE WHEN positive THEN 1.0::DOUBLE ELSE 0 END AS f_positive, floor((least(1, chars / 14::DOUBLE)) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_meaningful, floor((least(1, (informative + (alpha > 1)::INT + positive::INT) / 4::DOUBLE)) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_structure, floor((evidence) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_evidence, floor((height / top) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_prominence, floor((width * height / most) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_area,
    floor((greatest(0, 1 - (abs(x + width / 2 - 400) / 400 + abs(y + height / 2 - 300) / 300) / 2)) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_centrality, 1.0::DOUBLE AS f_alignment, 1.0::DOUBLE AS f_proximity, floor((short / alpha::DOUBLE) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_low_information, floor((odd / words::DOUBLE) * 1000000 + 0.5::DOUBLE) / 1000000::DOUBLE AS f_residual FROM f),
  k AS (SELECT *, (CAST(round(f_positive * 1000000) AS BIGINT) * 200 + CAST(round(f_meaningful * 1000000) AS BIGINT) * 160 + CAST(round(f_structure * 1000000) AS BIGINT) * 120 + CAST(round(f_evidence * 1000000) AS BIGINT) * 100 + CAST(round(f_prominence * 1000000) AS BIGINT) * 80 + CAST(round(f_area * 1000000) AS BIGINT) * 60 + CAST(round(f_centrality * 1000000) AS BIGINT) * 30 + CAST(round(f_alignment * 1000000) AS BIGINT) * 25 + CAST(round(f_proximity * 1000000) AS BIGINT) * 20 + CAST(round(f_low_information * 1000000) AS BIGINT) * (-180) + CAST(round(f_residual * 1000000) AS BIGINT) * (-140)) / 100000000.0::DOUBLE AS total FROM g)"""
FACTORS = ["positive", "meaningful", "structure", "evidence", "prominence", "area", "centrality", "alignment", "proximity", "low_information", "residual"]
KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s''-]', ' ', 'g'), '\\s+', ' ', 'g'))"
NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


#: What is put behind a title and a document's plain words, from line 5 on, and what is wrong then.
ENDS = [
    ("Fine end.", []), ("```\ncode", [(5, "FENCE_UNCLOSED")]), ("~~~~\n~~~\n#no\n~~~~\nAll closed here.", []), ("## Last", [(5, "TRUNC_EMPTY_FINAL_HEADING")]), ("This goes on and the", [(5, "TRUNC_DANGLING_WORD")]), ("See here:", [(5, "TRUNC_TRAILING_COLON")]), ("Three words only", [(5, "TRUNC_PROSE_NO_TERMINAL")]), ("- an item", []),
    ("#Heading\n\nEnd.", [(5, "HEADING_NO_SPACE")]), ("#1 is fine.", []), ("| a | b |\n|---|:-:-|", [(6, "TABLE_SEPARATOR_INVALID")]), ("A [link](x and more.", [(5, "LINK_MALFORMED")]), ("A [link] (x) more.", [(5, "LINK_MALFORMED")]), ("An [empty]() and [gone](#no-where) link.", [(5, "LINK_EMPTY"), (5, "LINK_ANCHOR_MISSING")]), ("To the [title](#the-title).", []),
]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a title, all letters of the text on one line, and an end by turns of ENDS."""
    end = F.element_at(F.array(*[F.lit(e) for e, _ in ENDS]), (F.col("doc_id") % len(ENDS) + 1).cast("int"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")
    return view(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# The title\n\n"), plain, F.lit(".\n\n"), end).alias("text"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each line item, by turns of WINDOWS."""
    # reading a window takes far longer than sending it: rows of one file go to all tasks
    base = spark.sql(READ.format("{l}"), l=view(spark, sf_dir, "lineitem")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.element_at(F.array(*[F.lit(w[0]) for w in WINDOWS]), F.col("t") + 1)
    return base.withColumn("statement", F.replace(F.replace(text, F.lit("{q}"), F.col("q").cast("string")), F.lit("{d}"), (F.col("q") % 10).cast("string")))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name candidates by turns of NAMED, two a line. Rows of a case meet before they become candidates, and stay together from there on."""
    base = spark.sql(NAMES.format("{l}"), l=dealt(view(spark, sf_dir, "lineitem"), "l_orderkey"))
    text = F.element_at(F.array(*[F.lit(x[0]) for x in NAMED]), F.col("t") + 1)
    words = F.transform(F.split("value", " "), lambda w: F.struct(w.alias("text"), F.lit(0.6).alias("confidence")))
    told = base.withColumn("value", text).withColumns({"words": words, "merged": F.lit(False), "positive": F.element_at(F.array(*[F.lit(x[2]) for x in NAMED]), F.col("t") + 1), "passes": F.array("pass_id")})
    return told.withColumns({"alignment": F.lit(None).cast("double"), "proximity": F.lit(None).cast("double")})


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the frame of the whole picture. Texts meet their pass before they are split, so no word is shuffled."""
    docs = view(spark, sf_dir, "documents")
    passes = spark.sql(PASSES.format("{t}"), t=docs).withColumnRenamed("case_id", "doc_id")
    return ex.in_frame(ex.words_of(docs.select("doc_id", "text").join(passes, "doc_id"), *ex.PASS))


def register(r: Registry) -> None:
    words = lambda s, d: ex.words_of(view(s, d, "documents"))
    lined = lambda s, d: words(s, d).select("case_id", F.floor(F.col("word_ix") / 8).cast("int").alias("line"), F.col("word_ix").alias("ix"), "text")
    turn = lambda a, b, c, e: f"CASE rotate WHEN 90 THEN {a} WHEN 180 THEN {b} WHEN 270 THEN {c} ELSE {e} END"
    r.add("x1_map_word_geometry", f"""WITH {WORDS}, p AS ({PASSES.format('documents')}), u AS (SELECT case_id, word_ix, rotate, crop_x, crop_y, w, h, x0 / scale AS a, y0 / scale AS b, x1 / scale AS c, y1 / scale AS d, w / scale::DOUBLE AS pw, h / scale::DOUBLE AS ph FROM words JOIN p USING (case_id)),
        m AS (SELECT case_id, word_ix, round(greatest(0, least({turn('b', 'pw - c', 'ph - d', 'a')} + crop_x, w)), 4) AS x0, round(greatest(0, least({turn('pw - c', 'ph - d', 'a', 'b')} + crop_y, h)), 4) AS y0, round(greatest(0, least({turn('d', 'pw - a', 'ph - b', 'c')} + crop_x, w)), 4) AS x1, round(greatest(0, least({turn('pw - a', 'ph - b', 'c', 'd')} + crop_y, h)), 4) AS y1 FROM u)
        SELECT * FROM m WHERE x1 > x0 AND y1 > y0""")(lambda s, d: mapped(s, d))  # fmt: skip
    r.add("x2_group_lines")(lambda s, d: ex.group_lines(words(s, d).select("case_id", "word_ix", "x0", "y0", "y1")).groupBy("case_id", "line").agg(F.count("*").alias("words"), F.min("word_ix").alias("first_word"), F.min("centre").alias("centre")))
    spans = " UNION ALL ".join(f"SELECT a.case_id, a.line, a.ix, {n} AS n, array_to_string([{', '.join(['a.text'] + [f't{i}' for i in range(1, n)])}], ' ') AS span FROM z a WHERE t{n - 1} IS NOT NULL" for n in range(2, 8))
    r.add("x3_line_windows", f"WITH {WORDS}, {LINED}, z AS (SELECT *, {', '.join(f'lead(text, {i}) OVER w AS t{i}' for i in range(1, 7))} FROM lined WINDOW w AS (PARTITION BY case_id, line ORDER BY ix)), s AS ({spans}) SELECT * FROM s WHERE regexp_matches(span, '[.]') AND regexp_matches(span, ',')")(
        lambda s, d: ex.line_windows(lined(s, d), "[.]", ",")
    )
    r.add("x4_adjacent_lines", f"""WITH {WORDS}, l AS (SELECT case_id, word_ix // 8 AS line, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL), n AS (SELECT *, lead(line) OVER w AS nline, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1 FROM l WINDOW w AS (PARTITION BY case_id ORDER BY line))
        SELECT case_id, line, nline AS next_line FROM n WHERE nline IS NOT NULL AND ny0 - y1 <= 1.8 * ((y1 - y0) + (ny1 - ny0)) / 2 AND abs((x0 + x1) - (nx0 + nx1)) / 2 / greatest(x1 - x0, nx1 - nx0) <= 0.9""")(
        lambda s, d: ex.adjacent_lines(words(s, d).withColumn("line", F.floor(F.col("word_ix") / 8).cast("int")))
    )
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    told = ", ".join(f"({i}, {quoted(k)}, {quoted(reason)}, {quoted(ops)})" for i, (_, k, _, _, reason, ops) in enumerate(WINDOWS))
    value = lambda n: "CASE w.t " + " ".join(f"WHEN {i} THEN {w[n]}" for i, w in enumerate(WINDOWS) if w[n]) + " END"
    r.add("x5_match_statements", f"WITH w AS ({READ.format('lineitem')}) SELECT case_id, line, q, w.t, kind, CAST({value(2)} AS INT) AS low, CAST({value(3)} AS INT) AS high, reason, operations FROM w JOIN (VALUES {told}) v(t, kind, reason, operations) ON v.t = w.t")(lambda s, d: ex.match_statements(windows(s, d)).drop("statement"))
    cand = "SELECT case_id, value, score / 50.0D AS score FROM {}"
    r.add("x6_select_statement", duck("fx_candidates", sql="""WITH b AS (SELECT case_id, value, max(score / 50.0::DOUBLE) AS score, count(*) AS support FROM fx_candidates GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS rival FROM b WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, value))
        SELECT case_id, value, score, support, CASE WHEN rival >= score - 0.2::DOUBLE THEN 'AMBIGUOUS' WHEN score < 0.6::DOUBLE THEN 'LOW_CONFIDENCE' ELSE 'OBSERVED' END AS state FROM k WHERE k = 1"""))(lambda s, d: ex.select_statement(s.sql(cand.format("{c}"), c=view(s, d, "fx_candidates"))))  # fmt: skip
    taken = ", ".join(f"({i}, '{reason}')" for i, (_, reason) in enumerate(LINES))
    r.add("x7_filter_name_lines", f"SELECT p_partkey AS id, reason FROM part JOIN (VALUES {taken}) v(t, reason) ON v.t = p_partkey % 16")(
        lambda s, d: ex.filter_name_lines(view(s, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(t) for t, _ in LINES]), (F.col("p_partkey") % 16 + 1).cast("int")).alias("text"))).select("id", "reason")
    )
    r.add("x8_trim_windows", f"WITH {DUCK_NAMES} SELECT case_id, id, first, n, span FROM n, (VALUES (2, 1, 'Sons'), (2, 2, 'Sons Cellars'), (3, 1, 'Cellars')) w(first, n, span) WHERE n.t = 4")(lambda s, d: ex.trim_windows(named(s, d)))
    r.add("x9_merge_adjacent_seeds", f"""WITH {DUCK_NAMES}, s AS (SELECT *, positive::INT * 2 + informative + evidence + height / 100 AS seed FROM n), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY case_id, pass_id, line, key ORDER BY seed DESC, id) = 1), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY case_id, pass_id, line ORDER BY seed DESC, id) <= 3),
        m AS (SELECT a.case_id, a.pass_id, a.line, a.id AS upper, b.id AS lower, a.text || ' ' || b.text AS value, greatest(greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / least(a.width, b.width), 1 - abs(a.x + a.width / 2 - b.x - b.width / 2) / greatest(a.width, b.width)) AS al, 1 - greatest(0, b.y - a.y - a.height) / (0.75::DOUBLE * (a.height + b.height)) AS pr
          FROM b a JOIN b ON b.case_id = a.case_id AND b.pass_id = a.pass_id AND b.line = a.line + 1 WHERE (a.positive OR b.positive) AND a.words + b.words <= 6 AND a.alpha + b.alpha <= 3)
        SELECT case_id, pass_id, line, upper, lower, value, round(greatest(0, least(1, al)), 6) AS alignment, round(greatest(0, least(1, pr)), 6) AS proximity FROM m WHERE al >= 0.3::DOUBLE AND pr > 0""")(lambda s, d: ex.merge_adjacent_seeds(named(s, d)))  # fmt: skip
    listed = ", ".join(f"f_{f}" for f in FACTORS)
    r.add("x10_score_candidates", f"WITH {DUCK_NAMES}, {DUCK_SCORED} SELECT case_id, id, {listed}, total FROM k")(lambda s, d: ex.score_candidates(named(s, d)).select("case_id", "id", *[f"f_{f}" for f in FACTORS], "total"))
    r.add("x11_select_name", f"""WITH {DUCK_NAMES}, {DUCK_SCORED}, fam AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY case_id, line ORDER BY total DESC, evidence DESC, id) = 1),
        sup AS (SELECT case_id, key, string_agg(DISTINCT pass_id, ',' ORDER BY pass_id) AS passes FROM fam GROUP BY ALL), one AS (SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY case_id, key ORDER BY total DESC, evidence DESC, id) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY height > 0.4::DOUBLE * top + 1 DESC, CASE WHEN height > 0.4::DOUBLE * top + 1 THEN total ELSE height END DESC, CASE WHEN height > 0.4::DOUBLE * top + 1 THEN height ELSE evidence END DESC, CASE WHEN height > 0.4::DOUBLE * top + 1 THEN evidence ELSE total END DESC, key) AS place FROM one),
        b AS (SELECT * FROM r WHERE place = 1), c AS (SELECT b.case_id, count(r.id) FILTER (r.height >= 0.8::DOUBLE * b.height) AS rivals, count(r.id) AS others FROM b LEFT JOIN r ON r.case_id = b.case_id AND r.place > 1 AND NOT contains(r.key, b.key) AND NOT contains(b.key, r.key) GROUP BY 1)
        SELECT b.case_id, b.id, b.text AS value, b.total, passes, rivals, CASE WHEN rivals > 0 OR (evidence < 0.6::DOUBLE AND others > 0) OR NOT positive OR evidence < 0.6::DOUBLE THEN 'AMBIGUOUS' ELSE 'OBSERVED' END AS state,
          CASE WHEN rivals > 0 OR (evidence < 0.6::DOUBLE AND others > 0) THEN 'competing_candidates' WHEN NOT positive OR evidence < 0.6::DOUBLE THEN 'single_unconfirmed_candidate' END AS reason FROM b JOIN c ON c.case_id = b.case_id JOIN sup ON sup.case_id = b.case_id AND sup.key = b.key""")(lambda s, d: ex.select_name(ex.score_candidates(named(s, d))))  # fmt: skip
    r.add("x12_merge_support", duck("fx_candidates", sql="SELECT case_id, value, string_agg(DISTINCT CAST(priority AS VARCHAR), ',' ORDER BY CAST(priority AS VARCHAR)) AS passes, max(score) AS score FROM fx_candidates GROUP BY ALL"))(lambda s, d: ex.merge_support(view(s, d, "fx_candidates")))
    r.add("x13_confidence_summary", f"WITH {WORDS} SELECT case_id, count(*) AS words, round(avg(raw_confidence), 4) AS mean, min(raw_confidence) AS low, max(raw_confidence) AS high, count(*) - count(raw_confidence) AS missing, round(greatest(0, least(1, avg(raw_confidence) / 100)), 6) AS score FROM words GROUP BY 1")(lambda s, d: ex.confidence_summary(words(s, d), ["case_id"]))
    q = "SELECT p_brand AS grp, concat(p_name, ' ', CAST(p_size AS {s}), CASE WHEN p_partkey % 3 = 0 THEN ' cl' WHEN p_partkey % 3 = 1 THEN ' ml x' ELSE ' L' END, CASE WHEN p_partkey % 4 = 0 THEN ', 0.5 litre' ELSE '' END) AS text FROM {t}"
    r.add("x20_quantity_summary", "WITH m AS (SELECT p_brand AS grp, p_size * CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 1000 END AS ml FROM part UNION ALL SELECT p_brand, 500 FROM part WHERE p_partkey % 4 = 0) SELECT m.grp, n, count(*) AS found, CAST(min(ml) AS DOUBLE) AS low, CAST(max(ml) AS DOUBLE) AS high, round(avg(ml), 4) AS mean FROM m JOIN (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1) c ON c.grp = m.grp GROUP BY m.grp, n")(lambda s, d: ex.quantity_summary(s.sql(q.format(s="STRING", t="{p}"), p=view(s, d, "part"))))
    names = "SELECT concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN '!' WHEN p_partkey % 4 = 1 THEN ' ' ELSE '' END) AS text FROM {}"
    r.add("x21_key_groups", f"WITH n AS ({names.format('part')}) SELECT {KEY.format('text')} AS key, count(*) AS n, count(DISTINCT text) AS variants, min(text) AS sample FROM n GROUP BY 1")(lambda s, d: ex.key_groups(s.sql(names.format("{p}"), p=view(s, d, "part")), tx.canonical(F.col("text"))))
    pair = "SELECT p_partkey AS id, p_name AS declared, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), '!') WHEN 2 THEN p_type ELSE concat(p_name, 's') END AS observed FROM {}"
    k1, k2 = KEY.format("declared"), KEY.format("observed")
    r.add("j18_declared_vs_observed", f"WITH p AS ({pair.format('part')}), k AS (SELECT *, {k1} AS a, {k2} AS b FROM p) SELECT id, CASE WHEN declared = observed THEN 'exact' WHEN a = b THEN 'equivalent' ELSE 'different' END AS equivalence, floor((1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE) * 100 + 0.5) / 100 AS similarity FROM k")(lambda s, d: ex.declared_vs_observed(s.sql(pair.format("{p}"), p=view(s, d, "part"))))
    r.add("j19_evaluate_rules", f"""WITH c AS ({CASES.format(s='VARCHAR', t='lineitem')}), p AS (SELECT *, state <> 'NOT_OBSERVED' AND statement IS NOT NULL AS seen, regexp_matches(statement, 'BY VOL|% vol') AS direct, CAST(regexp_extract(statement, '([0-9]+)', 1) AS INT) AS obs, TRY_CAST(regexp_extract(declared, '([0-9]+)', 1) AS INT) AS dec FROM c),
        f AS (SELECT case_id, sufficient, CASE WHEN brand IS NULL OR state = 'AMBIGUOUS' THEN 'NEEDS_REVIEW' WHEN replace(lower(brand), ', inc.', '') = lower(replace(declared_brand, '  ', ' ')) THEN 'PASS' ELSE 'FAIL' END AS b, CASE WHEN NOT seen OR state = 'AMBIGUOUS' THEN 'NEEDS_REVIEW' WHEN direct THEN 'PASS' ELSE 'FAIL' END AS s,
          CASE WHEN trim(declared) = '' OR NOT seen OR state = 'AMBIGUOUS' OR NOT direct THEN 'NEEDS_REVIEW' WHEN obs = dec THEN 'PASS' ELSE 'FAIL' END AS c FROM p)
        SELECT case_id, rule, CASE WHEN x IS NULL THEN 'not_run_external_dependency' WHEN sufficient THEN 'executed' ELSE 'not_run_insufficient_evidence' END AS execution, CASE WHEN x IS NULL OR NOT sufficient THEN 'not_run' ELSE x END AS finding FROM (
          SELECT case_id, sufficient, 'brand-name' AS rule, b AS x FROM f UNION ALL SELECT case_id, sufficient, 'alcohol-syntax', s FROM f UNION ALL SELECT case_id, sufficient, 'alcohol-declared', c FROM f UNION ALL SELECT case_id, sufficient, unnest(['actual-tolerance', 'omission-eligibility', 'class-boundary']), NULL FROM f)""")(
        lambda s, d: ex.evaluate_rules(s.sql(CASES.format(s="STRING", t="{l}"), l=view(s, d, "lineitem")))
    )
    suff = "SELECT case_id, state, has_value, in_ocr OR in_line OR in_candidate AS processed, case_id % 14 <> 0 AS same_digest FROM {}"
    r.add("j20_evidence_sufficiency", duck("fx_cases", sql=f"""WITH c AS ({suff.format('fx_cases')}), x AS (SELECT case_id, 'brand' AS "check", CASE WHEN NOT same_digest THEN 'DERIVATIVE_HASH_MISMATCH' WHEN NOT processed THEN 'ARTIFACT_REGION_NOT_PROCESSED' WHEN state = 'NOT_OBSERVED' THEN 'BRAND_NOT_OBSERVED' WHEN NOT has_value THEN 'BRAND_VALUE_EMPTY' ELSE 'BRAND_OBSERVATION_PRESENT' END AS reason FROM c
        UNION ALL SELECT case_id, 'alcohol', CASE WHEN NOT same_digest THEN 'DERIVATIVE_HASH_MISMATCH' WHEN NOT processed THEN 'ARTIFACT_REGION_NOT_PROCESSED' WHEN state = 'NOT_OBSERVED' THEN 'ALCOHOL_NOT_OBSERVED_BUT_PROCESSED' WHEN NOT has_value THEN 'ALCOHOL_VALUE_EMPTY' ELSE 'ALCOHOL_OBSERVATION_PRESENT' END FROM c)
        SELECT *, reason IN ('BRAND_OBSERVATION_PRESENT', 'ALCOHOL_OBSERVATION_PRESENT', 'ALCOHOL_NOT_OBSERVED_BUT_PROCESSED') AS sufficient FROM x"""))(lambda s, d: ex.evidence_sufficiency(s.sql(suff.format("{c}"), c=view(s, d, "fx_cases"))))  # fmt: skip
    r.add("j16_contamination", f"SELECT doc_id, item_id FROM (SELECT doc_id, {NORM} AS body FROM documents) JOIN (SELECT item_id, {NORM} AS passage FROM benchmark) ON contains(' ' || body || ' ', passage)")(lambda s, d: ex.contamination(view(s, d, "documents"), view(s, d, "benchmark")))
    r.add("j27_broken_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) SELECT link, count(DISTINCT page_id) AS pages FROM l WHERE link NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) FROM pages) GROUP BY 1")(lambda s, d: ex.broken_links(view(s, d, "pages")))
    ends = " UNION ALL ".join(f"SELECT {i} AS t, {line} AS line, '{code}' AS code" for i, (_, found) in enumerate(ENDS) for line, code in found)
    r.add("v17_document_lint", f"SELECT doc_id, CAST(line AS INT) AS line, code FROM documents JOIN ({ends}) e ON e.t = doc_id % {len(ENDS)}")(lambda s, d: ex.document_lint(marked(s, d)))
    r.add("v18_duplicate_lines", "WITH l AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(line), '[^a-z0-9 ]', '', 'g')), ' +', '-', 'g') AS slug FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id, slug, count(*) AS n FROM l WHERE slug <> '' GROUP BY ALL HAVING count(*) > 1")(lambda s, d: ex.duplicate_lines(view(s, d, "documents")))
