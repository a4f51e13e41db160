"""Tree queries over the leaves of chunk, and over documents as trees of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions.text import strip, token_len
from strataq.operators import tree as T
from strataq.providers import embed_texts
from strataq.session import latest, table

LEAF_COLUMNS = ["chunk_id", "muni", "ord", "tree_path", "name", "part", "has_table", "leaf_text", "ingested_at"]


def leaves(spark, sf_dir):
    return latest(table(spark, sf_dir, "chunk").select(*LEAF_COLUMNS), ["chunk_id"], ["ingested_at"])


def trees(spark, sf_dir):
    """One tree per municipality, put together from its leaves: tree_id is the municipality."""
    rows = leaves(spark, sf_dir).where("muni IS NOT NULL").withColumn("tree_id", F.col("muni"))
    return T.assemble_trees(rows)


def tree_sections(spark, sf_dir):
    """Every node of every tree, with its place: the numbers of its ancestors and its own among their siblings."""
    s = T.tree_sections(trees(spark, sf_dir))
    return s.select("tree_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), F.array_join("tree_path", "->").alias("path"), "name", "is_leaf", "has_table")


def tree_flatten(spark, sf_dir):
    s = T.flatten_leaves(T.tree_sections(trees(spark, sf_dir)))
    return s.select("tree_id", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"), "name", F.md5("leaf_text").alias("text_md5"))


def tree_merge(spark, sf_dir):
    """Small leaves merged all over the trees, nothing lost."""
    m = T.merge_tree(T.tree_sections(trees(spark, sf_dir)))
    return m.select("tree_id", F.array_join(F.col("parent").cast("array<string>"), ".").alias("parent"), "pos", "name", "is_leaf", F.md5("leaf_text").alias("text_md5"))


def small_leaf_candidates(spark, sf_dir):
    return leaves(spark, sf_dir).where((F.length("leaf_text") < 200) & (strip(F.col("leaf_text")) != "")).select("chunk_id", F.length("leaf_text").cast("long").alias("chars"))


def empty_drop(spark, sf_dir):
    return leaves(spark, sf_dir).where(strip(F.col("leaf_text")) != "").select("chunk_id", "name")


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    item = lambda t, i: F.struct(F.concat(F.lit("L"), (i + 1).cast("string")).alias("name"), t.alias("text"), F.lit(False).alias("has_table"))
    return docs.select("doc_id", F.transform(F.split("text", "\n"), item).alias("_l"))


def _merged(spark, sf_dir, reference):
    merged = _lines(spark, sf_dir).select("doc_id", F.posexplode(T.merge_leaves(F.col("_l"), reference=reference)).alias("pos", "_m"))
    return merged.select("doc_id", F.col("pos").cast("long").alias("pos"), "_m.name", F.md5("_m.text").alias("text_md5"))


def leaf_merge_fold(spark, sf_dir):
    return _merged(spark, sf_dir, True)


def leaf_merge_clean(spark, sf_dir):
    """Blank lines are dropped first and every sibling is looked at, so no text is lost."""
    return _merged(spark, sf_dir, False)


def fixed_stride_split(spark, sf_dir):
    parts = leaves(spark, sf_dir).where("leaf_text IS NOT NULL").select("chunk_id", F.inline(T.stride_split(F.col("leaf_text"))))
    return parts.select("chunk_id", "part", "tokens", F.md5("text").alias("text_md5"))


def recursive_split(spark, sf_dir):
    """Parts of every leaf; without what they share they are the leaf, whole."""
    p = T.split_recursively(leaves(spark, sf_dir))
    return p.select("chunk_id", "part", "shared", "tokens", F.md5("leaf_text").alias("text_md5"))


def prepare_text(spark, sf_dir):
    out = T.prepare_text(leaves(spark, sf_dir).where("leaf_text IS NOT NULL"))
    return out.select("chunk_id", F.md5("leaf_text").alias("leaf_md5"), F.md5("embed_text").alias("embed_md5"), "tokens")


def token_lengths(spark, sf_dir):
    return leaves(spark, sf_dir).select("chunk_id", token_len(F.col("leaf_text")).alias("tokens"))


def embed_leaves(spark, sf_dir):
    """A vector of each prepared leaf, by the default embedder."""
    prepared = T.prepare_text(leaves(spark, sf_dir).where("leaf_text IS NOT NULL"))
    return embed_texts(prepared, "chunk_id", "embed_text").select("chunk_id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm2"))


def embed_questions(spark, sf_dir):
    q = table(spark, sf_dir, "question").select(F.col("id").alias("question_id"), "question_detail")
    return embed_texts(q, "question_id", "question_detail").select("question_id", F.size("vec").alias("width"))


FUNCTIONS = [embed_leaves, embed_questions, tree_sections, tree_flatten, tree_merge, small_leaf_candidates, empty_drop, leaf_merge_fold, leaf_merge_clean, fixed_stride_split, recursive_split, prepare_text]
QUERIES = {f.__name__: f for f in FUNCTIONS} | {"token_len": token_lengths}

_S = r"[\s\x0B\x1C-\x1F\x{0085}\p{Z}]"
_STRIP = rf"regexp_replace(regexp_replace(leaf_text, '^{_S}+', ''), '{_S}+$', '')"
_LEAVES = "WITH l AS (SELECT unnest(m) FROM (SELECT arg_max({'chunk_id': chunk_id, 'tree_path': tree_path, 'name': name, 'has_table': has_table, 'leaf_text': leaf_text}, ingested_at) AS m FROM chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id)) "
# Every prefix of a leaf's ord is a node; its number is its rank among the children of its parent, level by level.
_TREES = """WITH RECURSIVE l AS (SELECT unnest(m) FROM (SELECT arg_max({'muni': muni, 'chunk_id': chunk_id, 'o': ord, 'p': tree_path, 'name': name, 'has_table': has_table, 'leaf_text': leaf_text}, ingested_at) AS m
    FROM chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id)),
  k AS (SELECT *, len(o) AS n FROM l WHERE muni IS NOT NULL AND len(p) > 0 AND len(o) = len(p) + 1),
  raw AS (SELECT muni, o[1:d] AS spot, o[1:d - 1] AS up, o[d] AS own, p[1:d - 1] AS path, CASE WHEN d = n THEN coalesce(name, '') ELSE p[d] END AS name, d = n AS is_leaf,
      CASE WHEN d = n THEN coalesce(has_table, false) ELSE false END AS has_table, CASE WHEN d = n THEN leaf_text END AS leaf_text, CASE WHEN d = n THEN chunk_id ELSE 0 END AS leaf
    FROM (SELECT *, unnest(range(1, n + 1)) AS d FROM k)),
  one AS (SELECT DISTINCT muni, spot, up, own, path, name, is_leaf, has_table, leaf_text, leaf FROM raw),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY muni, up ORDER BY own, name, leaf_text) - 1 AS num FROM one),
  nodes AS (SELECT muni AS tree_id, spot, ['0'] AS place, path, name, is_leaf, has_table, leaf_text FROM ranked WHERE len(spot) = 1
    UNION ALL SELECT r.muni, r.spot, list_append(n.place, CAST(r.num AS VARCHAR)), r.path, r.name, r.is_leaf, r.has_table, r.leaf_text FROM nodes n JOIN ranked r ON r.muni = n.tree_id AND r.up = n.spot AND NOT n.is_leaf)
"""
ORACLES = {
    "embed_questions": "SELECT id AS question_id, CAST(64 AS INTEGER) AS width FROM question",
    "tree_sections": _TREES + "SELECT tree_id, array_to_string(place, '.') AS ord, array_to_string(path, '->') AS path, name, is_leaf, has_table FROM nodes",
    "tree_flatten": _TREES + "SELECT tree_id, array_to_string(place, '.') AS ord, name, md5(leaf_text) AS text_md5 FROM nodes WHERE is_leaf",
    "small_leaf_candidates": _LEAVES + f"SELECT chunk_id, length(leaf_text) AS chars FROM l WHERE length(leaf_text) < 200 AND {_STRIP} <> ''",
    "empty_drop": _LEAVES + f"SELECT chunk_id, name FROM l WHERE {_STRIP} <> ''",
    "token_len": _LEAVES + r"SELECT chunk_id, CAST(coalesce(len(regexp_extract_all(leaf_text, '[^ \n]+')), 0) AS BIGINT) AS tokens FROM l",
    "prepare_text": _LEAVES
    + f""", p AS (SELECT chunk_id, tree_path, 'Section Path: ' || array_to_string(tree_path[2:], '->') || '->' || name || chr(10) || 'Section Text: ' || {_STRIP} AS t FROM l WHERE leaf_text IS NOT NULL)
      SELECT chunk_id, md5(t) AS leaf_md5, md5(array_to_string(tree_path, '->') || chr(10) || t) AS embed_md5, CAST(len(regexp_extract_all(t, '[^ \\n]+')) AS BIGINT) AS tokens FROM p""",
    "fixed_stride_split": _LEAVES
    + r""", t AS (SELECT chunk_id, regexp_extract_all(leaf_text, '[^ \n]+') AS ts FROM l WHERE leaf_text IS NOT NULL),
      w AS (SELECT chunk_id, CAST(0 AS BIGINT) AS part, ts AS ws FROM t WHERE len(ts) <= 1000
        UNION ALL SELECT chunk_id, s // 800 + 1, ts[s + 1:s + 1000] FROM (SELECT chunk_id, ts, unnest(range(0, len(ts) - 200, 800)) AS s FROM t WHERE len(ts) > 1000))
      SELECT chunk_id, part, CAST(len(ws) AS BIGINT) AS tokens, md5(coalesce(array_to_string(ws, ' '), '')) AS text_md5 FROM w""",
    "leaf_merge_fold": rf"""WITH RECURSIVE src AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda t, i: {{'n': 'L' || i, 't': t, 'd': false}}) AS l FROM documents WHERE text IS NOT NULL),
      f(doc_id, l, j, o, skip) AS (SELECT doc_id, l, 1, CAST([] AS STRUCT(n VARCHAR, t VARCHAR, d BOOLEAN)[]), false FROM src
        UNION ALL SELECT doc_id, l, j + 1,
          CASE WHEN skip THEN o WHEN length(l[j].t) >= 200 THEN list_append(o, l[j])
            WHEN regexp_replace(l[j].t, '^{_S}+', '') = '' THEN list_append(o, {{'n': l[j].n, 't': l[j].t, 'd': true}})
            WHEN len(o) = 0 AND j = len(l) THEN list_append(o, l[j])
            WHEN len(o) > 0 AND (j = len(l) OR length(o[-1].t) <= length(l[j + 1].t)) THEN
              list_concat(list_append(o[1:len(o) - 1], {{'n': o[-1].n || ' & ' || l[j].n, 't': o[-1].t || chr(10) || chr(10) || l[j].n || chr(10) || l[j].t, 'd': o[-1].d}}), CASE WHEN j < len(l) THEN [l[j + 1]] ELSE [] END)
            ELSE list_append(o, {{'n': l[j].n || ' & ' || l[j + 1].n, 't': l[j].t || chr(10) || chr(10) || l[j + 1].n || chr(10) || l[j + 1].t, 'd': false}}) END,
          CASE WHEN skip THEN false WHEN length(l[j].t) >= 200 OR regexp_replace(l[j].t, '^{_S}+', '') = '' OR (len(o) = 0 AND j = len(l)) THEN false
            WHEN len(o) > 0 AND (j = len(l) OR length(o[-1].t) <= length(l[j + 1].t)) THEN j < len(l) ELSE true END
        FROM f WHERE j <= len(l)),
      done AS (SELECT doc_id, list_filter(o, lambda x: NOT x.d) AS o FROM f WHERE j = len(l) + 1)
      SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, o[i].n AS name, md5(o[i].t) AS text_md5 FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS i FROM done)""",
}
