"""Registered queries of this subpackage and their DuckDB SQL.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` holds
the SQL of those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.llm import exact_dedup as dedup
from pulsepanel.llm import (fingerprint, hmm, html_crf, lexical_search, license_scan, mixing, ngram_join,
                            packing, prefix_trie, quality, sharding, warc)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ 1 mixing
def sql_mix(docs: str = "documents") -> str:
    """CTEs ending in ``mixed``: the mix of a table with doc_id, text, source."""
    return rf"""
sz as (
  select *, case when source is null then '1' else '0' || source end as src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('1|' || coalesce(doc_id::varchar, '~')), 1, 13))::bigint as h
  from {docs}),
dz as (select *, least(8, 1 + size // 64)::bigint as pref from sz),
per as (
  select src, s, ([5, 2, 1])[((row_number() over (order by src) - 1) % 3) + 1]::bigint as w
  from (select src, sum(size)::bigint as s from dz group by src)),
lv as (
  select *, (sum(s) over () * 150 - 100 * coalesce(sum(2 * s) over (
           order by s / w, src rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
         (sum(w) over (order by s / w, src rows between current row and unbounded following))::bigint as ws
  from per),
fl as (select *, 200 * s * ws <= w * lft as filled from lv),
tg as (
  select src, s, case when filled then 2.0::double * s
    else w * first_value(case when not filled then lft::double / (100 * ws) end ignore nulls) over (
      order by s / w, src rows between unbounded preceding and current row) end as target
  from fl),
wh as (
  select *, least(case when s > 0 then floor(target / s) else 0 end, 2)::bigint as whole from tg),
tr as (select *, target - whole * s as rest from wh),
cl as (
  select dz.src, pref, rest, sum(size)::bigint as words from dz join tr using (src)
  where size > 0 group by all),
tv as (
  select *, greatest((rest - coalesce(sum(words) over (partition by src order by pref desc
             rows between unbounded preceding and 1 preceding), 0))::double
           / sum(words * pref) over (partition by src order by pref desc
             rows between current row and unbounded following), 0.0) as a
  from cl),
ic as (
  select src, pref, least(1.0::double, coalesce(first_value(case when a * pref <= 1 then a end ignore nulls)
           over (partition by src order by pref desc
                 rows between unbounded preceding and current row) * pref, 1.0::double)) as p
  from tv),
dr as (
  select dz.*, tr.s as source_size, tr.target, tr.whole, tr.rest,
         case when p >= 1 then 0.0::double
              when p > 0 then ((h + 0.5::double) / 4503599627370496.0::double)
                / (1 - (h + 0.5::double) / 4503599627370496.0::double) / (p / (1 - p)) end as q
  from dz join tr using (src)
  left join ic on ic.src = dz.src and ic.pref = dz.pref and dz.size > 0),
ch as (
  select *, q is not null and sum(case when q is null then 0 else size end) over (
    partition by src order by q nulls last, doc_id nulls first
    rows between unbounded preceding and current row) <= rest as picked from dr),
gp as (
  select src, first(rest) - sum(case when picked then size else 0 end) as gap from ch group by src),
ex as (
  select src, doc_id as extra_id, true as extra from (
    select ch.src, doc_id, row_number() over (partition by ch.src
      order by abs(gap - size), size, doc_id nulls first) as n
    from ch join gp using (src) where not picked and q is not null and abs(gap - size) < gap)
  where n = 1),
mixed as (
  select ch.*, whole + picked::bigint + coalesce(extra, false)::bigint as copies
  from ch left join ex on ex.src = ch.src and ex.extra_id is not distinct from ch.doc_id)"""


@query("op1_mix_sources", f"""
with {sql_mix()}
select doc_id, size, source_size, target, copies, copies * size as taken from mixed
""")
def op1_mix_sources(spark, sf_dir):
    """Word targets, copies and words taken of every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 2 scoring
@query("op2_hmm_score")
def op2_hmm_score(spark, sf_dir):
    """Hidden Markov and unigram scores of every document."""
    return hmm.score_documents(table(spark, sf_dir, "documents"))


# ----------------------------------------------------------- 3 license scan
def sql_licenses() -> str:
    """The scan in SQL: the same k-grams joined as text."""
    rows = ", ".join(
        f"({i}, {str(exact).lower()}, '{label}', {'null::int' if tell is None else tell}, {words})"
        for i, (words, label, exact, _, tell) in enumerate(license_scan.templates()))
    k, short = license_scan.LONG, license_scan.SHORT
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t as (
  select *, len(tw) as n, case when len(tw) >= {k} then {k} else {short} end as k
  from (values {rows}) v(template, exact, label, tell, tw)),
ta as (select *, unnest(range(n - k + 1)) as spot from t),
g as (select template, exact, label, n, k, tell, spot, array_to_string(tw[spot + 1:spot + k], ' ') as gram from ta),
p as (select doc_id, ws, unnest(range(len(ws))) as pos from w),
d as (
  select doc_id, pos, {short} as k, array_to_string(ws[pos + 1:pos + {short}], ' ') as gram from p
  where pos + {short} <= len(ws)
  union all
  select doc_id, pos, {k}, array_to_string(ws[pos + 1:pos + {k}], ' ') from p where pos + {k} <= len(ws)),
h as (
  select distinct doc_id, template, exact, label, n, g.k, tell, spot, pos, pos - spot as diag
  from d join g on g.k = d.k and g.gram = d.gram),
e as (
  select doc_id, label, diag as first from h where exact
  group by doc_id, template, label, n, k, diag having count(*) = n - k + 1),
dg as (select distinct doc_id, template, diag from h where not exact),
lg as (select *, lag(diag) over (partition by doc_id, template order by diag) as prev from dg),
bd as (
  select *, sum(case when prev is null or diag - prev > {license_scan.NEIGHBOUR} then 1 else 0 end)
    over (partition by doc_id, template order by diag) as band from lg),
cw as (
  select h.doc_id, h.template, label, n, tell, band, spot, unnest(range(spot, spot + k)) as c
  from h join bd on bd.doc_id = h.doc_id and bd.template = h.template and bd.diag = h.diag
  where not exact),
cv as (
  select doc_id, label, count(distinct c)::double / n as cover,
         tell is null or bool_or(spot = tell) as own, min(spot) < tell and max(spot) > tell as over
  from cw group by doc_id, template, label, n, tell, band),
ls as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from e union all
        select doc_id, label from cv where own and cover >= {license_scan.COVER}) group by doc_id),
ba as (
  select doc_id, count(*) as n_base, min(first) as first_word, max(first) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels from e group by doc_id),
sc as (select doc_id, max(cover) as cover from cv where own or not over group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(cover, 0.0::double) end as score
from w left join ba using (doc_id) left join ls using (doc_id) left join sc using (doc_id)
"""


@query("op3_license_diagonals", sql_licenses())
def op3_license_diagonals(spark, sf_dir):
    """License phrases and passages of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


# ----------------------------------------------------------------- 4 quality
@query("op4_quality_network")
def op4_quality_network(spark, sf_dir):
    """Calibrated quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# -------------------------------------------------------------------- 5 WARC
@query("op5_warc_chunks", """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
         sha1(coalesce(html, '')) as payload_digest from pages),
t as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from t
""")
def op5_warc_chunks(spark, sf_dir):
    """Every page written to WARC archives and read back by chunks."""
    return warc.page_records(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------ 6 n-gram join
def sql_ngram(docs: str = "documents", size: int = 3, num: int = 90, den: int = 100) -> str:
    """CTEs ending in ``joined``: n_shingles, class_size, n_links and component
    of a table with doc_id and text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return rf"""
ng_w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\x20\x09-\x0D]+') as ws from {docs}),
ng_s as (
  select distinct doc_id, unnest(case
    when len(ws) >= {size} then list_transform(range(1, len(ws) - {size - 2}), lambda i: {gram})
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from ng_w),
ng_n as (select doc_id, count(*) as n, list(g order by g) as gs from ng_s group by doc_id),
ng_p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from ng_s a join ng_s b on a.g = b.g
  where a.doc_id <> b.doc_id group by all),
ng_l as (
  select x, y from ng_p join ng_n nx on nx.doc_id = x join ng_n ny on ny.doc_id = y
  where {den} * c >= {num} * (nx.n + ny.n - c)),
ng_r as (
  select doc_id as d, doc_id as r from ng_w
  union
  select ng_l.y, ng_r.r from ng_r join ng_l on ng_l.x = ng_r.d),
joined as (
  select w.doc_id, coalesce(n, 0) as n_shingles,
         case when n is null then 1 else count(*) over (partition by gs) end as class_size,
         (select count(*) from ng_l where x = w.doc_id) as n_links,
         (select min(r) from ng_r where d = w.doc_id) as component_id
  from ng_w w left join ng_n using (doc_id))"""


@query("op6_ngram_join", f"""
with recursive {sql_ngram()}
select * from joined
""")
def op6_ngram_join(spark, sf_dir):
    """Shingles, links and component of every document."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("_row", "first")


# ------------------------------------------------------------- 7 fingerprint
@query("op7_closed_syncmers")
def op7_closed_syncmers(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------- 8 exact dedup
@query("op8_exact_dedup", r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
""")
def op8_exact_dedup(spark, sf_dir):
    """Group of equal texts of every document."""
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 9 sharding
@query("op9_interleave_shards", r"""
with recursive step as (
  select i as n, i as x, 0 as k from range(256) r(i)
  union all
  select n, xor(x >> 1, 3988292384 * (x & 1)), k + 1 from step where k < 8),
tab as (select list(x order by n) as t from step where k = 8),
h as (
  select doc_id, case when source is null then '1' else '0' || source end as src,
         (strlen(coalesce(text, '')) + 16)::bigint as size,
         ('0x' || substr(md5('9|' || coalesce(doc_id::varchar, '~')), 1, 13))::bigint as u,
         list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
                        lambda b: ('0x' || b)::bigint) as bs
  from documents),
c as (
  select doc_id, src, size, u,
         xor(list_reduce(list_prepend(4294967295::bigint, bs),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32
  from h, tab),
f as (
  select *, ((row_number() over (partition by src order by u, doc_id, text_crc32) - 1) + 0.5::double)
            / count(*) over (partition by src) as fraction from c),
p as (
  select *, row_number() over (order by fraction, src, doc_id, text_crc32) - 1 as pos,
         count(*) over () as n from f)
select doc_id, size, text_crc32, 'rows' as law, (pos * 40 // n)::integer as shard,
       pos - ((pos * 40 // n) * n + 39) // 40 as slot, null::integer as grown_shard
from p
""")
def op9_interleave_shards(spark, sf_dir):
    """Shard and slot of every document under the law ``rows``."""
    out = sharding.interleave_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


# ---------------------------------------------------------------- 10 packing
def tokenizer_path() -> str:
    """File of the public vocabulary that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_pack_nnls")
def op10_pack_nnls(spark, sf_dir):
    """Pieces of every document, packed into sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


# ------------------------------------------------------------ 11 prefix trie
@query("op11_prefix_trie", r"""
with recursive step as (
  select i as n, i as x, 0 as k from range(256) r(i)
  union all
  select n, xor(x >> 1, 3988292384 * (x & 1)), k + 1 from step where k < 8),
tab as (select list(x order by n) as t from step where k = 8),
ts as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  where conv_id is not null),
td as (select *, sha256(strlen(role) || ':' || role || ':' || text) as digest from ts),
ow as (
  select conv_id, digest, strlen(text) as bytes,
         row_number() over (partition by conv_id order by turn nulls first, digest) as n from td),
cv as (
  select conv_id, xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(range(1, len(conv_id::varchar) + 1),
                                                           lambda i: ord(substr(conv_id::varchar, i, 1))::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint % 9 as h
  from (select distinct conv_id from ow), tab),
rb as (
  select cv.conv_id, ow.digest, ow.bytes, 0 as part, ow.n
  from cv join ow on ow.conv_id = cv.conv_id - cv.conv_id % 5 and ow.n <= h
  union all
  select cv.conv_id, ow.digest, ow.bytes, 1, ow.n from cv join ow on ow.conv_id = cv.conv_id and ow.n > h),
sq as (
  select conv_id, digest, bytes, row_number() over (partition by conv_id order by part, n) as depth from rb),
pa as (
  select conv_id, depth, bytes, sha256(string_agg(digest, '') over (
           partition by conv_id order by depth rows between unbounded preceding and current row)) as p
  from sq
  union all
  select conv_id, 0, 0, '' from cv),
me as (
  select *, min(conv_id) over (partition by depth, p) as node,
         max(depth) over (partition by conv_id) as len from pa),
nd as (
  select depth, node, any_value(bytes) as bytes, count(*) as n_convs, max(len) = depth as leaf,
         sha256(coalesce(string_agg(case when len = depth then conv_id::varchar end, ',' order by conv_id), ''))
           as ends_sha256
  from me group by depth, node),
up as (
  select nd.*, me.node as parent from nd
  left join me on me.conv_id = nd.node and me.depth = nd.depth - 1),
sub as (
  select me.node as a, me.depth as d, sum((n_convs - 1) * nd.bytes) as saved, count(*) filter (leaf) as leaves,
         count(*) filter (nd.depth = me.depth + 1) as kids
  from nd join me on me.conv_id = nd.node and me.depth <= nd.depth group by all)
select node as conv_id, depth, parent as parent_conv_id, n_convs, kids as n_children, leaves as n_leaves,
       saved::bigint as saved_tokens, ends_sha256
from up join sub on sub.a = up.node and sub.d = up.depth
""")
def op11_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of the rebuilt conversations."""
    keys = prefix_trie.conversation_keys(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.graft_keys(keys))


# ------------------------------------------------------------ 12 extraction
@query("op12_html_crf")
def op12_html_crf(spark, sf_dir):
    """Main text of every page."""
    return html_crf.extract_main(table(spark, sf_dir, "pages"))


# --------------------------------------------------------- 13 lexical search
@query("op13_lexical_search", r"""
with it as (
  select item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as item from (select distinct item_id, text from benchmark))),
qt as (select item, item_id, term, count(*) as times from it group by all),
ds as (select row_number() over () as d, doc_id, text from documents),
dt as (
  select d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from ds),
dn as (select d, any_value(doc_id) as doc_id, count(*) as n from dt group by d),
al as (select count(*) as nn, sum(n)::bigint as l from dn),
tf as (select d, term, count(*) as tf from dt where term in (select term from qt) group by all),
df as (select term, count(*) as df from tf group by term),
wt as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as w from df, al),
gn as (
  select tf.d, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) as gain
  from tf join dn using (d) join wt using (term), al),
sc as (
  select item, item_id, d, sum(times * gain)::bigint as score from qt join gn using (term) group by all),
rk as (
  select item_id, doc_id, score,
         row_number() over (partition by item order by score desc, doc_id nulls first) as rank
  from sc join dn using (d) where score > 0)
select item_id, rank::integer as rank, doc_id, score from rk where rank <= 20
""")
def op13_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
