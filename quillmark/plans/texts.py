"""Queries over texts: folds, tokens, languages, citations, ids, search, scores, sequences, alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import geometry, text, unicode
from quillmark.operators import alignment, decoding, evaluation, links, postings, search, sequences, versions
from quillmark.plans.registry import Tables, query, written_index
from quillmark.sources import export, readers

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"


@query("""select doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'vj', 'ui'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as folded
from documents where regexp_full_match(text, '[\\x00-\\x25\\x27-\\x3A\\x3C-\\x7F]*')""")
def q_fold_ascii(spark, folder):
    """The native fold over the texts that are ASCII (without & and ;, which abbreviate)."""
    d = Tables(spark, folder).documents.where(F.rlike("text", F.lit(r"^[\x00-\x25\x27-\x3A\x3C-\x7F]*$")))
    return d.select("doc_id", text.fold_latin(F.col("text")).alias("folded"))


@query()
def q_fold_text(spark, folder):
    """The full fold of every document, with its length and checksum."""
    folded = Tables(spark, folder).documents.select("doc_id", unicode.fold_text("text").alias("folded"))
    return folded.select("doc_id", F.length("folded").alias("n"), F.sha2("folded", 256).alias("digest"))


@query(f"select token, count(*) as n from (select unnest({_WORDS}) as token from documents) group by 1")
def q_tokens(spark, folder):
    return Tables(spark, folder).documents.select(F.explode(text.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select doc_id, lang, {_WORDS} as w from documents),
k as (select lang, token, row_number() over (partition by lang order by count(distinct doc_id) desc, token) as rn from (select lang, doc_id, unnest(w) as token from t) where lang is not null group by lang, token),
o as (select token, min(lang) as l from k where rn <= 40 group by token),
h as (select doc_id, l, count(*) as hits from (select doc_id, unnest(w) as token from t) join o using (token) group by 1, 2),
p as (select doc_id, len(w) as n, coalesce((select list_sort(list(hits), 'desc') from h where h.doc_id = t.doc_id), []) as s, (select arg_max(l, struct_pack(a := hits, b := -ascii(l) * 1000 - ascii(substr(l, 2)))) from h where h.doc_id = t.doc_id) as best from t),
r as (select doc_id, n, best, coalesce(s[1], 0) as top_hits, coalesce(s[2], 0) as second_hits, coalesce(list_sum(s), 0) as total from p)
select doc_id, cast(n as int) as n_tokens, case when n < 8 or top_hits < 2 then 'unknown' when top_hits / total >= 0.65 then best
when second_hits / total >= 0.25 then 'mixed' else 'unknown' end as verdict, round(case when total > 0 then top_hits / total else 0 end, 6) as score from r""")
def q_stopword_langid(spark, folder):
    """Verdicts by the forty commonest words of each labelled language; a word of several is the first one's."""
    d = Tables(spark, folder).documents
    tokens = d.select("doc_id", "lang", text.language_tokens(F.col("text")).alias("w"))
    lists = search.common_words(tokens, "lang", "doc_id", "w", 40)
    hits = tokens.select("doc_id", F.size("w").alias("n_tokens"), *(h.alias(f"_{k}") for k, h in text.stopword_hits(F.col("w"), lists).items()))
    v = text.language_verdict(F.col("n_tokens"), {k: F.col(f"_{k}") for k in lists})
    return hits.select("doc_id", "n_tokens", v["lang"].alias("verdict"), F.round(v["score"], 6).alias("score"))


@query("""select p_partkey, 'LH ' || cast(p_size as varchar) || ',' || cast(p_partkey % 9 + 1 as varchar) as key from part""")
def q_shelfmark_key(spark, folder):
    """Keys of shelfmarks written with Roman groups, leaves and notes: all of a part's spellings give one key."""
    roman = text.int_to_roman(F.col("p_size"))
    raw = F.concat(F.lit("ZEN LH. "), roman, F.lit(" , "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" Bl. 12 r–13v (Abschrift)"))
    return Tables(spark, folder).part.select("p_partkey", text.signature_key(raw).alias("key"))


@query("select p_partkey, cast(p_partkey % 4000 as int) as value from part where p_partkey % 4000 > 0")
def q_roman(spark, folder):
    p = Tables(spark, folder).part.where("p_partkey % 4000 > 0").select("p_partkey", text.int_to_roman(F.col("p_partkey") % 4000).alias("numeral"))
    return p.select("p_partkey", text.roman_to_int(F.col("numeral")).alias("value"))


@query("""select p_partkey, row_number() over (order by p_size, p_partkey) as place from part""")
def q_natural_sort(spark, folder):
    label = F.concat(F.lit("no "), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"))
    ranked = Tables(spark, folder).part.select("p_partkey", text.natural_key(label).alias("k"))
    return sequences.running(ranked, [], ["k"], name="place").select("p_partkey", "place")


@query("""select o_orderkey, cast(o_orderkey % 8 + 1 as int) as series, cast(o_orderkey % 30 + 1 as varchar) as volume, cast(o_orderkey % 500 + 1 as varchar) || case when o_orderkey % 2 = 0 then 'b' else '' end as piece from orders""")
def q_citation_parse(spark, folder):
    k = F.col("o_orderkey")
    cite = F.concat(F.lit("A "), text.int_to_roman(k % 8 + 1), F.lit(", "), (k % 30 + 1).cast("string"), F.lit(" N. "), (k % 500 + 1).cast("string"), F.when(k % 2 == 0, " b").otherwise(""))
    ref = text.edition_reference(cite)
    return Tables(spark, folder).orders.select("o_orderkey", ref["series"].alias("series"), ref["volume"].alias("volume"), ref["piece"].alias("piece"))


@query("""select l_orderkey, l_linenumber, cast(l_suppkey % 40 as int) as num, case l_linenumber % 3 when 0 then '' when 1 then 'r' else 'v' end as side from lineitem""")
def q_folio_labels(spark, folder):
    side = F.expr("case l_linenumber % 3 when 0 then '' when 1 then 'R' else 'v' end")
    ref = text.folio(F.concat(F.lit(" ["), (F.col("l_suppkey") % 40).cast("string"), side, F.lit("]")))
    return Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", ref["num"].alias("num"), ref["side"].alias("side"))


@query("""with s as (select o_orderkey, o_orderkey % 20 as a, o_orderkey % 20 + o_orderkey % 3 as b from orders), f as (select unnest(range(0, 24)) as num), g as (select num, unnest(['r', 'v']) as side from f)
select o_orderkey, cast(num as int) as num, side from s join g on num between a and b where not (num = a and side = 'r') and not (num = b and side = 'v')""")
def q_folio_span_sides(spark, folder):
    """Sides of folios inside spans "12v–13r", with the rules for recto and verso ends."""
    k = F.col("o_orderkey")
    spans = Tables(spark, folder).orders.select("o_orderkey", text.folio_span(F.concat((k % 20).cast("string"), F.lit("v–"), (k % 20 + k % 3).cast("string"), F.lit("r"))).alias("span"))
    each = spans.select("o_orderkey", "span", F.explode(F.sequence("span.lo", "span.hi")).alias("num")).withColumn("side", F.explode(F.array(F.lit("r"), F.lit("v"))))
    # a span on one folio from verso to recto is put in order, so it holds both sides
    ref = F.struct(F.col("num").alias("num"), F.col("side").alias("side"))
    inside = text.span_includes(F.col("span"), ref) & ~((F.col("span.lo") == F.col("span.hi")))
    return each.where(inside).select("o_orderkey", "num", "side")


@query("select doc_id, 'c-' || substr(sha256(doc_id || chr(31) || source || chr(31) || text), 1, 12) as cand_id, printf('%s:%04d', source, doc_id) as page_id from documents")
def q_sha_ids(spark, folder):
    d = Tables(spark, folder).documents
    return d.select("doc_id", text.sha_id("c-", 12, F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("cand_id"), text.page_id(F.col("source"), F.col("doc_id")).alias("page_id"))


@query("""with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
k as (select list_transform(string_split(source || ':' || doc_id, ''), lambda x: ascii(x)::bigint) as bytes from documents)
select cast(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 as int) as shard, count(*) as n from k, t group by 1""")
def q_crc_shards(spark, folder):
    """Documents by shard of four, by CRC-32 of their source and id."""
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    shard = sum((F.when(text.in_shard(key, i, 4), i).otherwise(0) for i in range(4)), F.lit(0))
    return Tables(spark, folder).documents.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _one_byte(table, text):
    """SQL of ``translate`` arguments that give each letter beyond ASCII a control character, as the SQL's levenshtein counts bytes; for 24 such letters or fewer."""
    controls = "".join(f" || chr({i})" for i in [*range(1, 9), *range(14, 30)]).removeprefix(" || ")
    letters = f"(select coalesce(string_agg(c, '' order by c), '') from (select distinct unnest(string_split({text}, '')) as c from {table}) where ord(c) > 127)"
    return f"{letters}, substr({controls}, 1, length({letters}))"


@query(f"""with b as (select item_id, translate(text, {_one_byte('benchmark', 'text')}) as t, length(text) as n from benchmark)
select a.item_id as one, b.item_id as other, cast(levenshtein(a.t, b.t) as int) as edits, round(1 - levenshtein(a.t, b.t)::double / greatest(a.n, b.n), 6) as like_ from b a join b on b.item_id = a.item_id + 1""")
def q_levenshtein_pairs(spark, folder):
    """Edits between each benchmark text and the next, in code points."""
    b = Tables(spark, folder).benchmark
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("text2"))
    return b.join(other, "item_id").select(F.col("item_id").alias("one"), "other", F.levenshtein("text", "text2").alias("edits"), F.round(text.similarity(F.col("text"), F.col("text2")), 6).alias("like_"))


_TURNS = f"""with x as (select conv_id, turn, role, translate(text, {_one_byte('conversations', 'text')}) as text from conversations),
p as (select role, text as r, lead(text) over (partition by conv_id order by turn) as h from x), q as (select role, r, h, levenshtein(r, h) as e, length(r) as n from p where r is not null and h is not null)"""


@query(f"""{_TURNS} select role, round(cast(sum(e) as double) / sum(n), 6) as micro_cer, round(avg(case when n > 0 then e::double / n when e > 0 then 1 else 0 end), 6) as macro_cer, cast(sum(e) as bigint) as edits, cast(sum(n) as bigint) as chars, count(*) as lines from q group by 1""")
def q_cer_micro_macro(spark, folder):
    """Error rates between each turn and the next, in code points."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = Tables(spark, folder).conversations.select("role", F.col("text").alias("r"), F.lead("text").over(w).alias("h")).where("r is not null and h is not null")
    rates = evaluation.error_rates(c, ["role"], "r", "h")
    return rates.withColumns({k: F.round(k, 6) for k in ("micro_cer", "macro_cer")})


@query()
def q_word_edits(spark, folder):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = Tables(spark, folder).conversations.select("conv_id", "turn", F.col("text").alias("r"), F.lead("text").over(w).alias("h")).where("h is not null")
    return c.select("conv_id", "turn", unicode.word_edits("r", "h").alias("edits"), F.size(F.split("r", r"\s+")).alias("words"))


@query()
def q_edit_mix(spark, folder):
    """Substitutions, insertions and deletions between neighbouring turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = Tables(spark, folder).conversations.select("role", F.col("text").alias("r"), F.lead("text").over(w).alias("h")).where("h is not null")
    made = c.select("role", alignment.edit_counts("r", "h").alias("m"))
    return made.groupBy("role").agg(*(F.sum(f"m.{k}").alias(k) for k in ("subs", "inss", "dels")))


# --- scores ------------------------------------------------------------------------------------------------------

_JUDGED = "(select l.quality = 1 as good, d.n_chars % 100 / 100.0::double as score, d.lang from labels l join documents d using (doc_id))"


def _judged(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("n_chars") % 100 / 100.0).alias("score"), "lang", (F.col("toxic") == 1).alias("toxic"))


_SWEEP = f"""select cast(threshold as double) as threshold, cast(count_if(good and score >= threshold) as bigint) as tp, cast(count_if(score >= threshold) as bigint) as said, cast(count_if(good) as bigint) as positives,
round(count_if(good and score >= threshold) / nullif(count_if(score >= threshold), 0), 6) as precision, round(count_if(good and score >= threshold) / count_if(good), 6) as recall
from {_JUDGED}, (values (0.1), (0.3), (0.5), (0.7), (0.9)) t(threshold) group by threshold"""


@query(_SWEEP)
def q_precision_recall_sweep(spark, folder):
    made = evaluation.sweep(_judged(Tables(spark, folder)), F.col("good"), "score", [0.1, 0.3, 0.5, 0.7, 0.9])
    return made.withColumns({k: F.round(k, 6) for k in ("precision", "recall")})


@query(f"select threshold, precision, recall from ({_SWEEP}) where precision >= 0.8 order by recall desc, threshold limit 1")
def q_threshold_pick(spark, folder):
    made = evaluation.sweep(_judged(Tables(spark, folder)), F.col("good"), "score", [0.1, 0.3, 0.5, 0.7, 0.9])
    picked = evaluation.pick_threshold(made.withColumns({k: F.round(k, 6) for k in ("precision", "recall")}), 0.8)
    return picked.select("threshold", "precision", "recall")


@query(f"select count_if(good and score >= 0.5) as tp, count_if(not good and score >= 0.5) as fp, count_if(good and score < 0.5) as fn, count_if(not good and score < 0.5) as tn from {_JUDGED}")
def q_confusion(spark, folder):
    return evaluation.confusion(_judged(Tables(spark, folder)), F.col("good"), F.col("score") >= 0.5)


@query(f"""with c as (select lang, count_if(good) as k, count(*) as n from {_JUDGED} group by 1), p as (select *, k / n as p, 1.96::double as z from c)
select lang, k, n, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as high from p""")
def q_wilson(spark, folder):
    c = _judged(Tables(spark, folder)).groupBy("lang").agg(F.count_if("good").alias("k"), F.count(F.lit(1)).alias("n"))
    bounds = evaluation.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "k", "n", *(F.round(v, 6).alias(k) for k, v in bounds.items()))


@query("select quality as verdict_a, toxic as verdict_b, count(*) as n from labels group by 1, 2")
def q_agreement_matrix(spark, folder):
    t = Tables(spark, folder).labels
    return evaluation.agreement(t.select("doc_id", F.col("quality").alias("v")), t.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query()
def q_bootstrap_ci(spark, folder):
    """Precision of each language with bootstrap bounds."""
    rows = _judged(Tables(spark, folder)).select("doc_id", "lang", F.col("good").cast("double").alias("x"), F.lit(1.0).alias("y"))
    return evaluation.bootstrap(rows, ["lang"], "x", "y", resamples=400, seed=1, key="doc_id")


# --- search ------------------------------------------------------------------------------------------------------


def _indexed(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars", text.words(F.col("text")).alias("w"))


_W = f"(select doc_id, lang, source, n_chars, {_WORDS} as w from documents)"


def _sql_has(word):
    return f"len(list_filter(w, lambda x: starts_with(x, '{word}'))) > 0" if len(word) >= 3 else f"list_contains(w, '{word}')"


def _sql_run(run):
    return f"contains(' ' || array_to_string(w, ' ') || ' ', ' {run} ')"


def _found(spark, folder, raw, **how):
    return postings.scored(written_index(spark, folder), spark, raw, fields=["text"], **how).select("doc_id")


@query(f"select doc_id from {_W} where {_sql_has('the')} and {_sql_has('ble')}")
def q_search_all(spark, folder):
    return _found(spark, folder, "the ble")


@query(f"select doc_id from {_W} where {_sql_has('heit')} or {_sql_has('ción')}".replace("ción", "cion"))
def q_search_any(spark, folder):
    return _found(spark, folder, "heit cion", any_word=True)


@query(f"select doc_id from {_W} where {_sql_run('of the')}")
def q_search_phrase(spark, folder):
    return _found(spark, folder, '"of the"')


@query(f"select doc_id from {_W} where {_sql_has('the')} and not {_sql_run('in the')} and not {_sql_run('was')}")
def q_search_exclude(spark, folder):
    return _found(spark, folder, 'the -"in the" -was')


@query(f"select doc_id from {_W} where {_sql_has('tionb')}")
def q_search_prefix(spark, folder):
    return _found(spark, folder, "tionb")


@query(f"select doc_id, n_chars from {_W} where {_sql_has('the')} and lang = 'en' and n_chars >= 2000")
def q_search_filters(spark, folder):
    index = written_index(spark, folder)
    # a value outside its vocabulary is dropped, not an error
    equal = search.known({"lang": "en", "source": "nowhere"}, {"source": ("src1",)})
    hits = postings.scored(index, spark, "the", fields=["text"], equal=equal, least={"n_chars": 2000})
    return hits.join(index.documents(spark).select(F.col("key").alias("doc_id"), "n_chars"), "doc_id").select("doc_id", "n_chars")


_TERMS = ("the", "was", "for")


def _bm25_sql(terms=_TERMS, test=None, digits=6, offset=0):
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))" for i in range(len(terms)))
    any_ = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"with b as (select doc_id, w, len(w) as len, {tf} from {_W}), s as (select count(*) as n, avg(len) as mean, {df} from b) select doc_id, round({score}, {digits}) as score from b, s where {test or any_ + ' > 0'} order by score desc, doc_id limit 10 offset {offset}"


@query(_bm25_sql())
def q_bm25_topk(spark, folder):
    scored = postings.bm25(written_index(spark, folder), spark, _TERMS, "text")
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc_id").limit(10)


@query(f"""select distinct token from (select unnest({_WORDS}) as token from documents) where length(token) between 5 and 7 and regexp_full_match(token, '[a-z]+') and levenshtein(token, 'tionbl') <= 1""")
def q_search_typo(spark, folder):
    vocabulary = written_index(spark, folder).terms(spark).where((F.col("field") == "text") & F.rlike("token", F.lit("^[a-z]+$"))).select("token")
    return search.typo_tokens(vocabulary, "tionbl")


@query(_bm25_sql(("the", "of"), f"{_sql_has('the')} and {_sql_run('of the')} and not {_sql_run('was')}", 4, 10))
def q_search_page(spark, folder):
    """The second page of a query's hits, ranked."""
    hits = _found(spark, folder, 'the "of the" -was')
    ranked = hits.join(postings.bm25(written_index(spark, folder), spark, ("the", "of"), "text"), "doc_id", "left")
    limit, offset = search.page_bounds(2, 10)
    return ranked.select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score")).orderBy(F.col("score").desc(), "doc_id").offset(offset).limit(limit)


@query()
def q_snippet(spark, folder):
    hits = Tables(spark, folder).documents.where(F.contains("text", F.lit("tionble")))
    return hits.select("doc_id", unicode.snippets(("tionble",))("text").alias("snippet"))


@query(f"select token, count(*) as docs, cast(sum(tf) as bigint) as tf from (select token, doc_id, count(*) as tf from (select doc_id, unnest({_WORDS}) as token from documents) group by 1, 2) group by 1")
def q_inverted_index(spark, folder):
    rows = written_index(spark, folder).postings(spark).where("field = 'text'")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("positions")).alias("tf"))


# --- pages, json -------------------------------------------------------------------------------------------------


@query("select lower(regexp_extract(url, '://([^/:?#]+)', 1)) as domain, count(*) as n from pages group by 1")
def q_url_domains(spark, folder):
    return Tables(spark, folder).pages.groupBy(text.domain_of(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang from pages")
def q_html_titles(spark, folder):
    p = Tables(spark, folder).pages
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("""with l as (select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as l from pages)
select page_id, cast(i as int) as row, trim(replace(l[i], '&amp;', '&')) as cells from (select page_id, l, unnest(range(1, len(l) + 1)) as i from l)""")
def q_html_tables(spark, folder):
    """Rows of tables, which the pages' lists are made into, as they have none."""
    listed = F.replace(F.replace("html", F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>"))
    rows = readers.html_tables(Tables(spark, folder).pages.select("page_id", listed.alias("html")))
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def q_json_props(spark, folder):
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return Tables(spark, folder).events.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select field, value, count(*) as n from (select 'lang' as field, lang as value from documents union all select 'source', source from documents) group by 1, 2""")
def q_export_tally(spark, folder):
    return export.tally(Tables(spark, folder).documents, ["lang", "source"])


@query("select json_object('role', role, 'turns', count(*)) as row from conversations group by role".replace("json_object('role', role, 'turns', count(*))", "'{\"role\":\"' || role || '\",\"turns\":' || count(*) || '}'"))
def q_json_rows(spark, folder):
    c = Tables(spark, folder).conversations.groupBy("role").agg(F.count(F.lit(1)).alias("turns"))
    return c.select(F.to_json(F.struct("role", "turns")).alias("row"))


# --- ordered rows ------------------------------------------------------------------------------------------------


@query("""with m as (select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by event_id) as step from events), s as (select *, sum(case when step <= 40 then 0 else 1 end) over (partition by user_id order by event_id) as g from m)
select user_id, min(event_id) as first, max(event_id) as last, count(*) as n from s group by user_id, g""")
def q_gaps_islands(spark, folder):
    return sequences.islands(Tables(spark, folder).events.select("user_id", "event_id"), ["user_id"], "event_id", gap=40)


@query("""select conv_id, turn, last_value(case when role = 'user' then length(text) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as carried from conversations""")
def q_carry_forward(spark, folder):
    c = Tables(spark, folder).conversations
    value = F.when(F.col("role") == "user", F.length("text")).cast("long")
    return c.select("conv_id", "turn", sequences.carried(c, ["conv_id"], "turn", value).alias("carried"))


@query("""select conv_id, string_agg(trim(text), ' ' order by turn) as text from conversations where not regexp_matches(text, '[-¬=]\\s*$') group by 1""")
def q_dehyphenate_concat(spark, folder):
    c = Tables(spark, folder).conversations.where(~F.rlike("text", F.lit(r"[-¬=]\s*$")))
    return sequences.joined_lines(c.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query("""with a as (select item_id, length(text) as la, substr(text, pos, 20) as gram, count(*) as x from (select item_id, unnest(range(1, length(text) - 18)) as pos, text from benchmark) group by all),
b as (select doc_id, lb, gram, count(*) as y from (select doc_id, length(text) as lb, substr(text, pos, 20) as gram from (select doc_id, unnest(range(1, length(text) - 18)) as pos, text from documents)) where gram in (select gram from a) group by all)
select item_id, doc_id, cast(sum(x * y) as bigint) as n from a join b using (gram) where case when la <= lb then x else y end <= 8 group by 1, 2""")
def q_kgram_anchors(spark, folder):
    """Anchors of all pairs of a benchmark passage and a document, by grams that are rare in the shorter of the two."""
    t = Tables(spark, folder)
    return sequences.anchors_by_text(t.benchmark, t.documents, a_key="item_id", b_key="doc_id", text="text", k=20, most=8).select("item_id", "doc_id", "n")


@query(f"""with w as (select {_WORDS} as w from documents) select n, gram, count(*) as count from (
select 1 as n, unnest(w) as gram from w union all select 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w) group by 1, 2""")
def q_ngram_counts(spark, folder):
    return decoding.ngram_counts(_indexed(Tables(spark, folder)).select("w"), "w", 2)


@query(f"""with w as (select {_WORDS} as w from documents), c as (select n, gram, count(*) as k from (
select 1 as n, unnest(w) as gram from w union all select 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w) group by 1, 2)
select n, gram, round(log10(k / sum(k) over (partition by n, case when n = 2 then split_part(gram, ' ', 1) else '' end)), 6) as log10p from c""")
def q_ngram_probabilities(spark, folder):
    counts = decoding.ngram_counts(_indexed(Tables(spark, folder)).select("w"), "w", 2)
    return decoding.conditional(counts).select("n", "gram", F.round("log10p", 6).alias("log10p"))


# --- alignment, decoding, vectors --------------------------------------------------------------------------------


@query()
def q_project_lines(spark, folder):
    """Each conversation's joined text projected back onto its turns."""
    c = Tables(spark, folder).conversations.select("conv_id", "turn", "text")
    whole = sequences.joined_lines(c, ["conv_id"], "turn", "text")
    return alignment.project_groups(c, whole, on="conv_id", order="turn", line="text", text="text", threshold=alignment.THRESHOLDS["fair"])


@query()
def q_infix_distance(spark, folder):
    """The cheapest place of each benchmark passage in the documents that share a 20-gram with it that is rare in the shorter."""
    t = Tables(spark, folder)
    met = sequences.anchors_by_text(t.benchmark, t.documents, a_key="item_id", b_key="doc_id", text="text", k=20, most=8)
    pairs = met.select("item_id", "doc_id").join(t.benchmark, "item_id").join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    return pairs.select("item_id", "doc_id", alignment.infix("text", "body").alias("p")).select("item_id", "doc_id", "p.*")


@query()
def q_ctc_greedy(spark, folder):
    """Best paths of vectors read as eight frames of eight labels."""
    e = Tables(spark, folder).embeddings
    return e.select("vec_id", decoding.decoder(8, temperature=0.1)("embedding").alias("d")).select("vec_id", "d.*")


@query()
def q_prefix_beam(spark, folder):
    e = Tables(spark, folder).embeddings
    return e.select("vec_id", decoding.decoder(8, beam=6, temperature=0.1)("embedding").alias("d")).select("vec_id", "d.*")


_BITS = " + ".join(f"(case when embedding[{i + 1}] > embedding[{(i + 1) % 64 + 1}] then {1 << (15 - i)} else 0 end)" for i in range(16))


@query(f"""with h as (select vec_id, label, {_BITS} as h, row_number() over (partition by label order by vec_id) as pos from embeddings)
select a.vec_id as one, b.vec_id as other, cast(bit_count(xor(a.h, b.h)) as int) as distance from h a join h b on a.label = b.label and b.pos between a.pos + 1 and a.pos + 8 where bit_count(xor(a.h, b.h)) <= 4""")
def q_window_hamming_pairs(spark, folder):
    e = Tables(spark, folder).embeddings.select("vec_id", "label", geometry.sign_hash(F.col("embedding"), 16).alias("h"))
    near = lambda a, b: geometry.hamming(a["h"], b["h"]) <= 4
    found = links.near_in_sequence(e, on=["label"], order="vec_id", within=8, condition=near)
    return found.select(F.col("a.vec_id").alias("one"), F.col("b.vec_id").alias("other"), geometry.hamming(F.col("a.h"), F.col("b.h")).alias("distance"))


@query("""select vec_id, round(abs(list_sum(list_transform(range(1, 9), lambda i: embedding[2*i-1]::double * embedding[2*(i % 8)+2]::double - embedding[2*(i % 8)+1]::double * embedding[2*i]::double))) / 2, 6) as area from embeddings""")
def q_polygon_area(spark, folder):
    """Areas of octagons made of a vector's first sixteen numbers."""
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.get("embedding", i * 2).cast("double"), F.get("embedding", i * 2 + 1).cast("double")))
    return Tables(spark, folder).embeddings.select("vec_id", F.round(geometry.polygon_area(points), 6).alias("area"))


@query("""with b as (select l_orderkey, l_linenumber, l_suppkey % 50 as x0, l_partkey % 50 as y0, l_suppkey % 50 + l_quantity as x1, l_partkey % 50 + 30 as y1 from lineitem),
p as (select a.l_orderkey, a.l_linenumber as one, b.l_linenumber as other, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as both_, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) as sum_
from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber) select l_orderkey, one, other, round(both_ / (sum_ - both_), 6) as iou from p where both_ / (sum_ - both_) >= 0.5""")
def q_iou_pairs(spark, folder):
    li = Tables(spark, folder).lineitem.selectExpr("l_orderkey", "l_linenumber", "cast(l_suppkey % 50 as double) x0", "cast(l_partkey % 50 as double) y0", "cast(l_suppkey % 50 + l_quantity as double) x1", "cast(l_partkey % 50 + 30 as double) y1")
    box = F.struct("x0", "y0", "x1", "y1")  # an order has a few lines, so its pairs are few
    a = li.select("l_orderkey", F.col("l_linenumber").alias("one"), box.alias("a"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("other"), box.alias("b"))
    paired = a.join(b, "l_orderkey").where("one < other").withColumn("iou", geometry.box_iou(F.col("a"), F.col("b")))
    return paired.where("iou >= 0.5").select("l_orderkey", "one", "other", F.round("iou", 6).alias("iou"))


@query("""select label, vec_id, n from (select label, vec_id, count(*) over (partition by label) as n, row_number() over (partition by label order by list_sum(list_transform(embedding, lambda x: x::double * x::double)) desc, vec_id) as rn from embeddings) where rn = 1""")
def q_norm_argmax(spark, folder):
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    e = Tables(spark, folder).embeddings.select("label", "vec_id", norm.alias("norm"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n"))
    return versions.current_rows(e, ["label"], [F.col("norm").desc(), F.col("vec_id")]).select("label", "vec_id", "n")
