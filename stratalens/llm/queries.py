"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import chat, decontaminate, edit_counts, exact_dedup, filter_audit, group_matrix, hash_tree, line_crf, line_dedup, merkle, mixing, piece_table, token_frames
from stratalens.llm.shared import load


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_output(load(spark, sf_dir, "documents"))


def op2_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.removals(load(spark, sf_dir, "documents"))
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda k: k.cast("string")), ","))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(load(spark, sf_dir, "documents"), share=0.6, max_epochs=4)
    return out.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("__contaminated").alias("contaminated"), F.col("__item").alias("item_id"), F.col("__score").alias("score"), F.col("__hits").alias("seed_hits"))


def op6_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = edit_counts.build_trees(load(spark, sf_dir, "documents").select("doc_id", "text"))
    out = edit_counts.apply_edits(trees, edit_counts.sample_edits(F.col("doc_id"), F.col("text")))
    return out.select("doc_id", "n_tokens", "new_tokens", F.char_length("text").cast("long").alias("new_chars"), "encoded_chars", "n_leaves")


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(load(spark, sf_dir, "documents"), shards=8)


def op8_group_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matrix.similarity_components(load(spark, sf_dir, "documents"))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(load(spark, sf_dir, "conversations"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 7 divides are folded from a leaf with one more in n_chars."""
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = [one_more if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    out = merkle.manifest(load(spark, sf_dir, "documents"), variants={"tampered": tampered})
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = out.withColumn("folded_root", merkle.fold(F.when(chosen, F.col("tampered")).otherwise(F.col("leaf")), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_table.decode(piece_table.encode(load(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_line_crf_quality": op2_line_crf_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_hierarchical_mixing": op4_hierarchical_mixing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_edit_token_counts": op6_edit_token_counts,
    "op7_hash_tree_sharding": op7_hash_tree_sharding,
    "op8_group_matrix_join": op8_group_matrix_join,
    "op9_chat_snapshots": op9_chat_snapshots,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sentence_pieces": op13_sentence_pieces,
}


def _draw(node: hash_tree.Node) -> str:
    bits = f"('0x' || substr(md5(concat(coalesce(doc_id::varchar, 'null'), '|{node.name}')), 1, 13))::bigint"
    return f"(ln(({bits}::double + 0.5) / {float(2**52)}) / {float(node.weight)})"


def _tree_sql(node: hash_tree.Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _tree_sql(node.children[0])
    best = "greatest(" + ", ".join(_draw(c) for c in node.children) + ")"
    whens = " ".join(f"when {_draw(c)} = {best} then {_tree_sql(c)}" for c in node.children[:-1])
    return f"(case {whens} else {_tree_sql(node.children[-1])} end)"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _crc_sql() -> str:
    """CRC-32 of the bytes whose hex text is ``h``."""
    return f"""xor(list_reduce(
        list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint),
        lambda acc, b: xor(acc >> 8, {_crc_table()}[(xor(acc, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"""


def _op7_sql() -> str:
    crc = _crc_sql()
    return f"""
    with rows as (
        select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size, {crc}::bigint as text_crc32,
            {_tree_sql(hash_tree.topology(8))}::integer as shard, {_tree_sql(hash_tree.topology(9))}::integer as grown_shard,
            ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % {hash_tree.BUCKETS} as bucket
        from (select doc_id, text, hex(encode(coalesce(text, ''))) as h from documents))
    select doc_id, size, text_crc32, 'key' as law, shard,
        row_number() over (partition by shard order by bucket, doc_id, size, text_crc32) - 1 as slot, grown_shard
    from rows"""


OP9_SQL = """
with t as (
    select distinct conv_id, coalesce(turn, -1)::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
c as (
    select conv_id, count(*) as n_turns, list(struct_pack(turn := turn, role := role, text := text) order by turn, role, text) as items,
        string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by turn, role, text) as rendered
    from t group by conv_id),
s as (
    select items, rendered, min(conv_id) as conv_id, min(n_turns) as n_turns, count(*) as copies from c group by items, rendered),
p as (
    select distinct items[1:k] as items from c, (select unnest(range(1, 1 + (select max(n_turns) from c))) as k) where k < n_turns)
select conv_id, n_turns, copies, rendered from s where not exists (select 1 from p where p.items = s.items)
"""

OP10_SQL = """
with n as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256
from n join g using (norm)
"""

#: Shingles as lists of words; links by a join on shingles; components as the smallest of all that is reachable.
OP8_SQL = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as l from documents),
s as (
    select distinct doc_id, unnest(list_transform(range(1, greatest(len(l) - 4, 1) + 1), lambda i: l[i:i + 4])) as g from w where len(l) > 0 and doc_id is not null),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 80 * (x.n + y.n - c)),
reached as (select doc_id as node, doc_id as other from n union select r.node, l.b from reached r join links l on l.a = r.other),
smallest as (select node, min(other) as component_id from reached group by node)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join smallest on node = w.doc_id
"""

#: Words in the order of their line counts; prefixes of the shorter and the longer set; lengths; whole sets.
OP3_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as line_no
    from documents),
w as (
    select distinct doc_id, line_no, unnest(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+')) as word from lines),
sets as (select doc_id, line_no, list(word order by word) as s, count(*) as n from w where word <> '' group by all),
classes as (select s, n, min(struct_pack(d := doc_id, k := line_no)) as id from sets group by all),
each as (select id, n, unnest(s) as word from classes),
df as (select word, count(*) as c from each group by word),
ranked as (select id, n, word, row_number() over (partition by id order by c, word) as i from each join df using (word)),
pairs as (
    select distinct a.id as a, b.id as b
    from ranked a join ranked b on a.word = b.word and a.id < b.id and a.n * 100 >= b.n * 80 and b.n * 100 >= a.n * 80
    where a.i <= a.n - (80 * a.n + 99) // 100 + 1 and b.i <= b.n - (80 * b.n + 99) // 100 + 1),
sized as (
    select p.b, len(list_intersect(x.s, y.s)) as c, x.n + y.n as total
    from pairs p join classes x on x.id = p.a join classes y on y.id = p.b),
gone as (select distinct b as id from sized where 100 * c >= 80 * (total - c)),
removed as (
    select doc_id, line_no from sets join classes using (s) left join gone using (id)
    where gone.id is not null or struct_pack(d := doc_id, k := line_no) > id)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::bigint as n_lines, coalesce(r.c, 0)::bigint as n_removed, coalesce(r.l, '') as removed
from documents d left join (select doc_id, count(*) as c, string_agg(line_no::varchar, ',' order by line_no) as l from removed group by doc_id) r using (doc_id)
"""

#: Masks of failed filters, all orders as strings, and each step's counts from the masks.
OP11_SQL = """
with w as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as l from documents),
firsts as (select t, min(doc_id) as first_id from w group by t),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
flags as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        (len(l) < 200)::int + 2 * (100 * len(list_distinct(l)) < 50 * len(l))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > first_id, false)::int as mask
    from w join firsts using (t) left join marks on marks.doc_id = w.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (select filter_order, k::int as step, bits[k] as own, coalesce(list_sum(bits[1:k - 1]), 0)::int as earlier from orders, unnest([1, 2, 3, 4, 5]) as u(k)),
sums as (
    select part, filter_order, step, own,
        sum(n * (mask & (earlier | own) = 0)::int)::bigint as kept,
        sum(n * (mask & earlier = 0 and mask & own > 0)::int)::bigint as removed,
        sum(n * (mask & earlier > 0 and mask & own > 0)::int)::bigint as redundant,
        sum(n * (mask = own)::int)::bigint as unique_fails,
        sum(good * (mask & earlier = 0 and mask & own > 0)::int)::bigint as good_lost,
        sum(toxic * (mask & earlier = 0 and mask & own > 0)::int)::bigint as toxic_lost
    from cells, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from sums
"""

#: Levels by recursion, per language and then over the languages; proofs and folds along each leaf's path.
OP12_SQL = """
with recursive leaves as (
    select doc_id, lang, sha256(pre || chars || post) as leaf,
        sha256(pre || case when crc %% 7 = 0 and n_chars is not null then octet_length(encode((n_chars + 1)::varchar)) || ':' || (n_chars + 1)::varchar else chars end || post) as altered
    from (
        select doc_id, lang, n_chars, %(crc)s as crc, %(doc_id)s || %(source)s || %(lang)s as pre, %(n_chars)s as chars, %(text)s as post
        from (select *, hex(encode(coalesce(doc_id::varchar, ''))) as h from documents))),
numbered as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by lang nulls first) - 1 as g from leaves),
t as (
    select g, 0 as lvl, pos, leaf as d, count(*) over (partition by g) as n from numbered
    union all
    select g, lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), (any_value(n) + 1) // 2 from t where n > 1 group by g, lvl, pos // 2),
subs as (select g, d from t where n = 1),
u as (
    select 0 as lvl, g as pos, d, (select count(*) from subs) as n from subs
    union all
    select lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), (any_value(n) + 1) // 2 from u where n > 1 group by lvl, pos // 2),
path as (
    select p.g, p.pos as leaf_pos, t.lvl, p.pos >> t.lvl as place, t.n from numbered p join (select distinct g, lvl, n from t where n > 1) t on t.g = p.g
    union all
    select p.g, p.pos, 1000 + u.lvl, p.g >> u.lvl, u.n from numbered p, (select distinct lvl, n from u where n > 1) u),
sib as (
    select path.g, leaf_pos, path.lvl, place, coalesce(t.d, u.d, '') as s
    from path left join t on path.lvl < 1000 and t.g = path.g and t.lvl = path.lvl and t.pos = xor(place, 1)
    left join u on path.lvl >= 1000 and u.lvl = path.lvl - 1000 and u.pos = xor(place, 1)),
proofs as (select g, leaf_pos, string_agg(s, '' order by lvl) as proof, list(struct_pack(s := s, odd := place %% 2 = 1) order by lvl) as steps from sib group by all),
folds as (
    select g, pos, altered as acc, 1 as k from numbered
    union all
    select f.g, f.pos, case when p.steps[k].odd then sha256(p.steps[k].s || acc) else sha256(acc || p.steps[k].s) end, k + 1
    from folds f join proofs p on p.g = f.g and p.leaf_pos = f.pos where k <= len(p.steps)),
folded as (select g, pos, arg_max(acc, k) as folded_root from folds group by all)
select n.doc_id, n.leaf, subs.d as subroot, root.d as root, sha256(coalesce(p.proof, '')) as proof_sha256, folded_root, folded_root = root.d as verified
from numbered n join subs using (g) join folded using (g, pos) left join proofs p on p.g = n.g and p.leaf_pos = n.pos, (select d from u where n = 1) root
"""


def _op12_sql() -> str:
    shown = {c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end" for c in merkle.FIELDS}
    return OP12_SQL % (shown | {"crc": _crc_sql()})


ORACLE: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op7_hash_tree_sharding": _op7_sql(), "op8_group_matrix_join": OP8_SQL, "op9_chat_snapshots": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": _op12_sql()}
