"""Queries over the project's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import Options
from quillmesh.functions import text as X
from quillmesh.operators import blocking, cluster, curve, evaluate, index, linkage, similarity
from quillmesh.operators.components import over_terms
from quillmesh.session import Scratch
from quillmesh.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Least tf-idf and entity similarity at which the queries link two questions.
LINK = 0.5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return S.table(spark, d, name)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _round_many(df: DataFrame, *names: str) -> DataFrame:
    """As :func:`_round` for values of 0 or more, as DuckDB does it and without a decimal number for each value."""
    for c in names:
        t = F.col(c) * 1e6
        df = df.withColumn(c, (F.floor(t) + (t - F.floor(t) >= 0.5).cast("bigint")) / 1e6)
    return df


# ---------------------------------------------------------------- sources

def _category(c: str) -> str:
    return f"""case when {c} is null or {c} in ('Unknown','Non Selected','') then 'Unknown' when position('--' in {c}) = 0 then {c}
  when trim(split_part({c},'--',1)) = 'Science' then trim(split_part({c},'--',2)) else trim(split_part({c},'--',1)) end"""


@query(f"""select question_id, regexp_replace(body,'[fF]or 10 points','FTP','g') as text, {_category('trim(category)')} as category, author, round, tournament
from questions where question_id is not null group by all""")
def question_scan(spark, d):
    return S.question_model(t(spark, d, "questions"))


@query("select feature, censored, word_id from vocab union all select '', 0, max(word_id)+1 from vocab")
def vocab_terms(spark, d):
    return S.vocabulary(t(spark, d, "vocab"))


@query(f"select distinct {_category('trim(category)')} as category from cat_backup")
def category_list(spark, d):
    return t(spark, d, "cat_backup").select(X.category(F.trim("category")).alias("category")).distinct()


@query("""select question_id, count(*) filter (reference=1) as reference_rows, count(*) filter (coalesce(username<>'default',false)) as human_rows,
 count(*) filter (coalesce(username<>'default',false) and correct=1) as "right", count(*) filter (coalesce(username<>'default',false) and correct=0) as wrong
from (select distinct * from answers) where question_id is not null group by question_id""")
def answer_responses(spark, d):
    return S.responses(t(spark, d, "answers"))


_ANSWER = """select question_id, answer_id, answer_text from (select m.question_id, answer_id, answer_text, row_number() over (partition by question_id order by answer_id desc, answer_text desc) k
 from question_mapping m join cannonical_answer c using(answer_id) where question_id is not null) where k=1"""


def _answers(spark, d):
    return S.canonical_answers(t(spark, d, "question_mapping"), t(spark, d, "cannonical_answer"))


@query(_ANSWER)
def canonical_answers(spark, d):
    return _answers(spark, d)


@query(f"select q.question_id, coalesce(a.answer_id,-1) as answer_id, coalesce(a.answer_text,'') as answer_text from (select distinct question_id from questions where question_id is not null) q left join ({_ANSWER}) a using(question_id)")
def answer_lookup(spark, d):
    return S.answer_lookup(t(spark, d, "questions"), _answers(spark, d))


_FREQUENT = "select distinct q.question_id, m.answer_id, c.answer_text, c.answer_count from questions q join question_mapping m using(question_id) join cannonical_answer c on c.answer_id=m.answer_id where c.answer_count>=5"


def _frequent(spark, d):
    return S.frequent(t(spark, d, "questions"), t(spark, d, "question_mapping"), t(spark, d, "cannonical_answer"))


@query(_FREQUENT)
def frequent_questions(spark, d):
    return _frequent(spark, d)


@query(f"select question_id, max(answer_count) as answer_count from ({_FREQUENT}) group by 1 order by 2 desc, 1 limit 100")
def limited_questions(spark, d):
    """The 100 questions of the most frequent answers."""
    return S.limited(_frequent(spark, d), 100)


@query(f"select distinct question_id, body from questions where question_id in (select question_id from ({_FREQUENT}))")
def acceptable_questions(spark, d):
    return t(spark, d, "questions").select("question_id", "body").join(_frequent(spark, d).select("question_id"), "question_id", "left_semi").distinct()


@query("select distinct answer_text from question_mapping join cannonical_answer using(answer_id)")
def answers_seen(spark, d):
    return _answers_all(spark, d).select("answer_text").distinct()


def _answers_all(spark, d):
    return t(spark, d, "question_mapping").join(t(spark, d, "cannonical_answer"), "answer_id")


_TOKENS = r"""select distinct question_id as rec_id, token_offset as pos, lower(regexp_replace(feature,'^[\s\p{Z}]+|[\s\p{Z}]+$','','g')) as term
 from features where question_id is not null and regexp_replace(feature,'^[\s\p{Z}]+|[\s\p{Z}]+$','','g') <> ''"""


def _tokens(spark, d):
    return S.tokens(t(spark, d, "features"))


@query(_TOKENS)
def tokens(spark, d):
    return _tokens(spark, d)


@query(f"select rec_id as question_id, string_agg(term,' ' order by pos, term) as features from ({_TOKENS}) group by 1")
def ordered_features(spark, d):
    return S.ordered_features(t(spark, d, "features")).withColumn("features", F.array_join("features", " "))


@query(_TOKENS + " and question_id = 100005")
def feature_lookup(spark, d):
    return S.tokens(t(spark, d, "features").where("question_id = 100005"))


@query(f"select rec_id as question_id, count(*) as known from ({_TOKENS}) t join (select distinct lower(feature) as term from vocab where feature is not null) v using(term) group by 1")
def vocab_features(spark, d):
    known = t(spark, d, "vocab").where("feature is not null").select(F.lower("feature").alias("term")).distinct()
    return _tokens(spark, d).join(known, "term").groupBy(F.col("rec_id").alias("question_id")).agg(F.count(F.lit(1)).alias("known"))


@query(f"""with k as (select lower(feature) as term, min(word_id) as word_id from vocab where feature is not null group by 1), r as ({_TOKENS})
select rec_id as question_id, pos, word_id from r join k using(term) union all select distinct rec_id, 0, (select max(word_id)+1 from vocab) from r""")
def mapped_features(spark, d):
    return S.mapped_features(t(spark, d, "features"), t(spark, d, "vocab"))


@query(f"select rec_id as question_id, cast(coalesce(max(case when term='ftp' then pos end),-1) as int) as ftp_pos from ({_TOKENS}) group by 1")
def marker_position(spark, d):
    return S.marker_position(t(spark, d, "features"))


@query("""select distinct question_id, answer_text, answer_count, '"' || replace(coalesce(body,''),'"','') || '"' as body from questions join question_mapping using(question_id) join cannonical_answer using(answer_id) where answer_count>=5""")
def export_questions(spark, d):
    return S.export(t(spark, d, "questions"), t(spark, d, "question_mapping"), t(spark, d, "cannonical_answer"))


@query("""select row_number() over (order by answer_count desc, answer_text, question_id, answer_id) as place, question_id, answer_text, answer_count from (
 select distinct question_id, m.answer_id, answer_text, answer_count from questions join question_mapping m using(question_id) join cannonical_answer c on c.answer_id=m.answer_id where answer_count>=5)""")
def export_order(spark, d):
    """The place of each exported question."""
    rows = _frequent(spark, d).withColumn("one", F.lit(1).cast("bigint"))
    order = [F.desc("answer_count"), F.col("answer_text"), F.col("question_id"), F.col("answer_id")]
    return evaluate.running_total(rows, order, "one", "place").select("place", "question_id", "answer_text", "answer_count")


@query("""select question_id, coalesce(string_agg(text, '|' order by text) filter (reference=1), '') as reference, coalesce(string_agg(text, '|' order by text) filter (username<>'default'), '') as human
from (select distinct * from answers) where question_id is not null group by 1""")
def answer_lists(spark, d):
    return S.answer_lists(t(spark, d, "answers")).select("question_id", F.array_join("reference", "|").alias("reference"), F.array_join("human", "|").alias("human"))


_LABELS = f"select question_id as rec_id, answer_id as label from ({_ANSWER})"


def _labels(spark, d):
    return _answers(spark, d).select(F.col("question_id").alias("rec_id"), F.col("answer_id").alias("label"))


@query(f"""select rec_id, label, case when k<=1 then 'test' when k<=2 then 'dev' else 'train' end as split from (select rec_id, label, row_number() over (partition by label order by rec_id) k from ({_LABELS}))""")
def train_dev_test_split(spark, d):
    return S.split(_labels(spark, d), "rec_id", "label", dev=1, test=1)


@query(f"select l.rec_id, coalesce(o.label, cast(l.label as varchar)) as label from ({_LABELS}) l left join (values (100005,'entropy (short story)'),(100011,'ethics (work)')) o(rec_id,label) using(rec_id)")
def label_override(spark, d):
    o = spark.createDataFrame([(100005, "entropy (short story)"), (100011, "ethics (work)")], "rec_id bigint, label string")
    return S.overridden(_labels(spark, d), o)


@query("select row_number() over (order by question_id) - 1 as idx, question_id, answer_text as label, answer_id as label_id from (" + _ANSWER + ")")
def question_ids(spark, d):
    rows = _answers(spark, d).withColumn("one", F.lit(1).cast("bigint"))
    return evaluate.running_total(rows, [F.col("question_id")], "one", "k").select((F.col("k") - 1).alias("idx"), "question_id", F.col("answer_text").alias("label"), F.col("answer_id").alias("label_id"))


# ---------------------------------------------------------------- text

_BODY = "select distinct question_id as rec_id, regexp_replace(body,'[fF]or 10 points','FTP','g') as body from questions where question_id is not null and body is not null"


def _bodies(spark, d):
    q = t(spark, d, "questions")
    return q.where("question_id is not null and body is not null").select(F.col("question_id").alias("rec_id"), X.ftp_rewrite(F.col("body")).alias("body")).distinct()


@query(rf"select rec_id, count(*) as tokens, count(distinct t) as distinct_tokens from (select rec_id, unnest(regexp_extract_all(body,'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')) as t from ({_BODY})) group by 1")
def body_tokens(spark, d):
    return _bodies(spark, d).select("rec_id", F.explode(X.tokenized(F.col("body"))).alias("t")).groupBy("rec_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("t").alias("distinct_tokens"))


@query(rf"""with t as (select rec_id, body, unnest(regexp_extract_all(body,'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+')) as w, generate_subscripts(regexp_extract_all(body,'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+'),1) as i from ({_BODY})),
 g as (select rec_id, w || '~' || lead(w) over x || '~' || lead(w,2) over x as ngram from t window x as (partition by rec_id, body order by i))
select ngram, count(*) as n, count(distinct rec_id) as records from g where ngram is not null group by 1""")
def ngrams(spark, d):
    return _bodies(spark, d).select("rec_id", F.explode(X.ngrams(F.col("body"))).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_id").alias("records"))


_ENTITIES = rf"select rec_id, term, count(*) as cnt from (select rec_id, unnest(regexp_extract_all(body,'\p{{Lu}}\p{{Ll}}+(?:\s\p{{Lu}}\p{{Ll}}+)*')) as term from ({_BODY})) where term<>'FTP' group by all"


def _entities(spark, d):
    return similarity.entity_counts(_bodies(spark, d), "rec_id", X.entities(F.col("body")))


@query(_ENTITIES)
def entity_counts(spark, d):
    return _entities(spark, d)


@query(f"select rec_id, term from (select rec_id, term, unnest(range(cnt)) from ({_ENTITIES}))")
def entity_expand(spark, d):
    return similarity.expanded(_entities(spark, d))


_THIS = r"unnest(regexp_extract_all(body,'\bthis(?:\s\p{Ll}+){1,3}'))"


@query(f"select distinct rec_id, array_to_string(list_filter(regexp_split_to_array({_THIS},'\\s+')[2:], lambda x: x <> 'FTP'),' ') as phrase from ({_BODY})")
def referer_phrases(spark, d):
    """Distinct noun phrases after ``this``, by the default extractor."""
    return _bodies(spark, d).select("rec_id", F.explode(X.referers(F.col("body"))).alias("phrase")).distinct()


# ---------------------------------------------------------------- index and similarity

_INDEX = """c as (select rec_id, lower(term) as term, count(*) as cnt from ({rows}) group by all), l as (select rec_id, sum(cnt)+{start} as doclen from c group by 1),
 n as (select count(*) as n from l), f as (select term, count(*) as df, ln(cast((select n from n) // count(*) as double)) as idf from c group by 1),
 w as (select rec_id, term, cnt, cnt/doclen as tf, df, idf, cnt*(cnt/doclen)*idf as w from c join l using(rec_id) join f using(term))"""
_TOK_INDEX = "with " + _INDEX.format(rows=_TOKENS, start=1)
_ENT_INDEX = "with " + _INDEX.format(rows=f"select rec_id, term from (select rec_id, term, unnest(range(cnt)) from ({_ENTITIES}))", start=0)
_SCORES = "select x.rec_id as x, y.rec_id as y, round(sum(x.tf*x.tf*x.idf),6) as score from w x join w y using(term) where x.rec_id<>y.rec_id and x.idf<>0 group by 1,2 having sum(x.tf*x.tf*x.idf)<>0"
_DOT = "select a.rec_id as a, b.rec_id as b, sum(a.w*b.w) as tfidf from w a join w b using(term) where a.rec_id<b.rec_id and a.w<>0 and b.w<>0 group by 1,2"
_NAMED = f"select x.rec_id as a, y.rec_id as b, sum(x.cnt*y.cnt) as named from ({_ENTITIES}) x join ({_ENTITIES}) y using(term) where x.rec_id<y.rec_id group by 1,2"


def _index(spark, d):
    return index.Index(_tokens(spark, d))


def _entity_index(spark, d):
    return index.Index(similarity.expanded(_entities(spark, d)), start=0)


@query(f"{_TOK_INDEX} select rec_id, term, cnt, round(tf,6) as tf from w")
def term_freq(spark, d):
    return _round(_index(spark, d).tf.select("rec_id", "term", "cnt", "tf"), "tf")


@query(f"{_TOK_INDEX} select term, df, round(idf,6) as idf from f")
def doc_freq_idf(spark, d):
    return _round(_index(spark, d).df.select("term", "df", "idf"), "idf")


@query(f"{_TOK_INDEX} select rec_id, term, round(w,6) as w from w")
def tfidf_weights(spark, d):
    return _round(_index(spark, d).weights.select("rec_id", "term", "w"), "w")


@query(f"{_TOK_INDEX} select rec_id, count(*) as terms from w group by 1")
def index_report(spark, d):
    return _index(spark, d).report()[1]


@query(f"""with r as ({_TOKENS}), x as (select distinct term from r) select term, row_number() over (order by term) - 1 as term_id from x""")
def term_ids(spark, d):
    """Terms as numbers, in the order of their bytes."""
    return index.numbered(_tokens(spark, d))


@query(f"""{_TOK_INDEX}, a as (select rec_id, term from (select distinct rec_id from c), (values ('ftp'),('i'),('no such term')) v(term))
select a.rec_id, a.term, round(coalesce(w.tf,0),6) as tf, round(coalesce(f.idf,0),6) as idf from a left join w using(rec_id, term) left join f on f.term=a.term""")
def term_lookup(spark, d):
    """Frequencies of three terms in every question, 0 where there are none."""
    built = _index(spark, d)
    asked = built.tf.select("rec_id").distinct().withColumn("term", F.explode(F.array(*(F.lit(x) for x in ("ftp", "i", "no such term")))))
    return _round(built.lookup(asked), "tf", "idf")


@query(f"with r as ({_TOKENS}) select rec_id, lower(term) as term, count(*) as cnt from r where length(term) > 3 group by all")
def filtered_terms(spark, d):
    """Term counts under a filter: more than three characters."""
    return index.Index(_tokens(spark, d), keep=F.length("term") > 3).tf.select("rec_id", "term", "cnt")


@query()
def telling_terms(spark, d):
    """Document frequencies without stop words and short terms; the list of stop words is Spark's."""
    return _round(index.Index(_tokens(spark, d), keep=index.telling()).df.select("term", "df", "idf"), "idf")


@query(f"{_TOK_INDEX} {_SCORES}")
def doc_scores(spark, d):
    return _round_many(_index(spark, d).scores(), "score")


@query(f"{_ENT_INDEX} {_SCORES}")
def entity_scores(spark, d):
    return _round_many(_entity_index(spark, d).scores(), "score")


@query(f"{_TOK_INDEX} select a, b, round(tfidf,6) as tfidf from ({_DOT})")
def tfidf_pair_similarity(spark, d):
    return _round_many(_index(spark, d).dot(), "tfidf")


@query(f"select a, b, cast(named as bigint) as named from ({_NAMED})")
def entity_similarity(spark, d):
    return similarity.entity_similarity(_entities(spark, d))


@query(f"""{_TOK_INDEX}, t as ({_DOT}), e as ({_NAMED}) select coalesce(t.a,e.a) as a, coalesce(t.b,e.b) as b, round(coalesce(tfidf,0),6) as tfidf, 0.0::double as category, 0.5::double as referers,
 cast(coalesce(named,0) as double) as named, round(coalesce(tfidf,0)+0.0+0.5+coalesce(named,0),6) as total from t full join e on t.a=e.a and t.b=e.b""")
def pair_similarity_total(spark, d):
    return _round_many(similarity.total_over_terms(_index(spark, d).terms(), _entities(spark, d), Options()), "tfidf", "total")


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey<b.n_nationkey")
def all_pairs(spark, d):
    return similarity.all_pairs(t(spark, d, "nation"), "n_nationkey")


# ---------------------------------------------------------------- blocking

_CATS = f"select question_id as rec_id, min({_category('trim(category)')}) as category from questions where question_id is not null group by 1"


def _categories(spark, d):
    return S.question_model(t(spark, d, "questions")).groupBy(F.col("question_id").alias("rec_id")).agg(F.min("category").alias("category"))


def _h(n: int, mask: int) -> str:
    return f"select rec_id, min(cast(('0x' || substr(md5('{n}:' || term),1,8)) as bigint) & {mask}) as key from ({_ENTITIES}) group by 1"


@query(_h(3, 7))
def minhash_keys_md5(spark, d):
    return blocking.minhash_keys(_entities(spark, d), 3, 0b111, hashed=blocking.md5_hash)


@query()
def minhash_keys(spark, d):
    return blocking.minhash_keys(_entities(spark, d), 3, 0b111)


_BLOCKS = f"select 0 as criterion, category || '/' || key as key, rec_id from ({_h(0, 3)}) join ({_CATS}) using(rec_id)" + "".join(f" union all select {k}, cast(key as varchar), rec_id from ({_h(3, 7)})" for k in (1, 2, 3))


def _blocks(spark, d):
    return blocking.blocks(_entities(spark, d), _categories(spark, d), hashed=blocking.md5_hash)


@query(_BLOCKS)
def block_assignments(spark, d):
    return _blocks(spark, d)


@query(f"select category, key, count(*) as records from ({_h(0, 3)}) join ({_CATS}) using(rec_id) group by 1,2")
def block_by_category(spark, d):
    kinds = _categories(spark, d)
    return blocking.minhash_keys(_entities(spark, d), 0, 0b11, hashed=blocking.md5_hash).join(kinds, "rec_id").groupBy("category", "key").agg(F.count(F.lit(1)).alias("records"))


def _canopies(spark, d):
    ids = _bodies(spark, d).select("rec_id").distinct()
    return blocking.canopies(ids, _entity_index(spark, d).near(), 0.0, 0.01)


# centers one by one in ascending order: a record is one unless an earlier center holds it tightly
_CANOPIES = f"""{_ENT_INDEX.replace("with ", "with recursive ", 1)}, sc as materialized (select x.rec_id as x, y.rec_id as y, sum(x.tf*x.tf*x.idf) as score from w x join w y using(term) where x.rec_id>y.rec_id and x.idf<>0 group by 1,2),
 ids as materialized (select rec_id, row_number() over (order by rec_id) as k from (select distinct rec_id from ({_BODY}))), tt as materialized (select p.k as p, list(c.k) as cs from sc join ids p on p.rec_id=sc.x join ids c on c.rec_id=sc.y where score>0.01 group by 1),
 go as (select 1::bigint as k, [1::bigint] as cen union all select k+1, case when list_has_any(coalesce((select cs from tt where p=k+1),[]), cen) then cen else list_append(cen, k+1) end from go where k < (select count(*) from ids)),
 cn as materialized (select rec_id as c from ids where k in (select unnest(cen) from go where k=(select count(*) from ids))), hd as (select sc.x as p, sc.y as c, score from sc join cn on cn.c=sc.y where score>0),
 tk as (select p, min(c) as taken from hd where score>0.01 group by 1), cp as (select c as center, p as rec_id from hd left join tk using(p) where (taken is null or c<=taken) and p not in (select c from cn) union select c, c from cn
 union select hd.c, hd.p from hd join cn on cn.c=hd.p left join tk on tk.p=hd.p where taken is null and hd.c<hd.p)"""


@query(f"{_CANOPIES} select * from cp")
def canopies(spark, d):
    return _canopies(spark, d)


@query(f"{_CANOPIES} select count(*) as canopies, round(avg(n),6) as mean_size from (select count(*) as n from cp group by center)")
def mean_canopy_size(spark, d):
    return _round(blocking.canopy_size(_canopies(spark, d)), "mean_size")


# ---------------------------------------------------------------- clustering


def _linked(spark, d):
    """Pairs of questions whose entity weights have a dot product of ``LINK`` or more."""
    return _entity_index(spark, d).linked(LINK)


def _ids(spark, d):
    return _bodies(spark, d).select("rec_id").distinct()


_REACH = f"""{_ENT_INDEX.replace("with ", "with recursive ", 1)}, e as (select a, b from ({_DOT}) where tfidf>={LINK}), v as (select distinct rec_id from ({_BODY})), u as (select a, b from e union all select b, a from e),
 r as (select rec_id as x, rec_id as y from v union select r.x, u.b from r join u on r.y=u.a), ex as (select x as rec_id, min(y) as cluster from r group by 1)"""


@query(f"{_REACH} select * from ex")
def single_link_clusters(spark, d):
    return cluster.single_link_terms(_ids(spark, d), _entity_index(spark, d).terms(), LINK)


@query()
def complete_link_clusters(spark, d):
    return linkage.agglomerate_terms(_ids(spark, d), _entity_index(spark, d).terms(), LINK, "min").clusters


@query()
def mean_link_clusters(spark, d):
    return linkage.agglomerate_terms(_ids(spark, d), _entity_index(spark, d).terms(), LINK, "mean").clusters


@query()
def canopy_clusters(spark, d):
    canopy = _canopies(spark, d)
    return cluster.single_link_terms(canopy, _entity_index(spark, d).terms(), LINK, canopy.select("rec_id", F.col("center").alias("part")))


@query()
def lego_clusters(spark, d):
    return blocking.iterative_blocking_terms(_ids(spark, d), _blocks(spark, d), _entity_index(spark, d).terms(), LINK)


@query(f"{_REACH} select cluster, count(*) as size from ex group by 1")
def cluster_report(spark, d):
    return single_link_clusters(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query(f"{_REACH} select rec_id, cluster as component from ex where rec_id in (select a from u)")
def linked_components(spark, d):
    return over_terms(_entity_index(spark, d).terms(), LINK)


# ---------------------------------------------------------------- evaluation


@query(f"select label, string_agg(cast(rec_id as varchar), ',' order by rec_id) as records from ({_LABELS}) group by 1")
def gold_clusters(spark, d):
    # a list of a cluster's records is the feature here; the figures below need none
    return _labels(spark, d).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_set("rec_id")), lambda x: x.cast("string")), ",").alias("records"))


_TABLE = f"""{_REACH}, g as ({_LABELS}), ct as (select cluster as e, label as g, count(*) as n from ex join g using(rec_id) group by 1,2),
 re as (select e, sum(n) as ne from ct group by 1), rg as (select g, sum(n) as ng from ct group by 1)"""
_PAIRWISE = """, z as (select (select coalesce(sum(n*(n-1)/2),0) from ct)::double as h, (select coalesce(sum(ne*(ne-1)/2),0) from re)::double as pe, (select coalesce(sum(ng*(ng-1)/2),0) from rg)::double as pg),
 q as (select case when pe>0 then h/pe else 0.0 end as p, case when pg>0 then h/pg else 0.0 end as r from z)"""
_EXACT = """, y as (select (select count(*) from ct join re using(e) join rg using(g) where n=ne and n=ng)::double as h, (select count(*) from re)::double as ke, (select count(*) from rg)::double as kg),
 k as (select case when ke>0 then h/ke else 0.0 end as p, case when kg>0 then h/kg else 0.0 end as r from y)"""
_VI = "(select round(coalesce(sum(n/t*(ln(ne/n)+ln(ng/n))),0),6) from (select n::double as n, ne::double as ne, ng::double as ng, (select sum(ne) from re)::double as t from ct join re using(e) join rg using(g)))"
_F1 = "round(case when p+r>0 then 2*p*r/(p+r) else 0.0 end,6)"


def _table(spark, d):
    return evaluate.Contingency(single_link_clusters(spark, d), _labels(spark, d))


@query(f"{_TABLE}{_PAIRWISE} select round(p,6) as precision, round(r,6) as recall, {_F1} as f1 from q")
def pairwise_f1(spark, d):
    return _round(_table(spark, d).pairwise(), "precision", "recall", "f1")


@query(f"{_TABLE}{_EXACT} select round(p,6) as cluster_precision, round(r,6) as cluster_recall, {_F1} as cluster_f1 from k")
def cluster_f1(spark, d):
    return _round(_table(spark, d).exact(), "cluster_precision", "cluster_recall", "cluster_f1")


@query(f"{_TABLE} select {_VI} as vi")
def variation_of_information(spark, d):
    return _round(_table(spark, d).variation(), "vi")


@query(f"""{_TABLE}{_PAIRWISE}{_EXACT} select round(q.p,6) as precision, round(q.r,6) as recall, round(case when q.p+q.r>0 then 2*q.p*q.r/(q.p+q.r) else 0.0 end,6) as f1,
 round(k.p,6) as cluster_precision, round(k.r,6) as cluster_recall, round(case when k.p+k.r>0 then 2*k.p*k.r/(k.p+k.r) else 0.0 end,6) as cluster_f1, {_VI} as vi from q, k""")
def accuracy_report(spark, d):
    r = _table(spark, d).report()
    return _round(r, *r.columns)


@query(f"""{_ENT_INDEX}, g as ({_LABELS}), p as (select a, b, round(tfidf,6) as s from ({_DOT})), m as (select p.a, p.b, s, (x.label=y.label)::int as hit from p join g x on x.rec_id=p.a join g y on y.rec_id=p.b),
 o as (select a, b, s, sum(hit) over w as hits, count(*) over w as seen from m window w as (order by s desc, a, b rows unbounded preceding)), gp as (select sum(k*(k-1)/2)::double as gp from (select count(*) k from g group by label)),
 v as (select a, b, s, hits/seen as p, hits/(select gp from gp) as r from o)
select a, b, s as threshold, round(p,6) as precision, round(r,6) as recall, round(case when p+r>0 then 2*p*r/(p+r) else 0.0 end,6) as f1 from v""")
def pr_curve(spark, d):
    return curve.precision_recall(_entity_index(spark, d).terms(), _labels(spark, d))


@query()
def merge_trace(spark, d):
    gold = _labels(spark, d)
    found = linkage.agglomerate_terms(_ids(spark, d), _entity_index(spark, d).terms(), LINK, "mean", gold=gold)
    return evaluate.merge_trace(found.merges, gold)


@query()
def informative_features(spark, d):
    """What each part of the similarity added to the scores at which clusters merged, mean linkage over their sum.

    The parts that are the same for every pair are taken off the threshold, as
    in ``Run``: tf-idf and entity similarity together must reach ``LINK``.
    """
    o, scratch = Options(), Scratch(spark)
    constant = {"category": o.category_weight, "referers": 0.5 * o.referers_weight}
    own = scratch.save(_entity_index(spark, d).terms())
    names = scratch.save(_entities(spark, d).select("rec_id", "term", F.col("cnt").cast("double").alias("w")))
    both = own.withColumn("term", F.concat(F.lit("t "), "term")).unionByName(names.withColumn("term", F.concat(F.lit("n "), "term")))  # both weights are 1
    part = scratch.save(over_terms(both, LINK, scratch=scratch))
    tfidf = index.dot(own, "w", part).withColumnRenamed("s", "tfidf")
    named = index.dot(names, "w", part).withColumnRenamed("s", "named")
    pairs = tfidf.join(named, ["a", "b"], "full").na.fill(0.0, ["tfidf", "named"]).withColumn("s", F.col("tfidf") + F.col("named"))
    found = cluster.agglomerate(_ids(spark, d), pairs, LINK, "mean", scratch=scratch, parts=("tfidf", "named"))
    return _round(found.informative(("tfidf", "named"), constant), "value")


# ---------------------------------------------------------------- runs


@query("select l as record_limit, k as tight from (values (10),(40),(100),(250),(500)) a(l), (values ('INVERSE'),('INVERSESQRT'),('INVERSELOG')) b(k)")
def parameter_grid(spark, d):
    from quillmesh.plans.runs import grid

    return grid(spark)


@query()
def sweep(spark, d):
    """Figures of canopy runs for all 15 settings of the standard sweep, maximum linkage."""
    from quillmesh.plans.runs import sweep as run

    rows = run(spark, d, algorithm="MAXCLUSTER", feature_distance_threshold=3.0)
    return _round(rows, "f1", "precision", "recall", "cluster_f1", "cluster_precision", "cluster_recall", "vi")


@query("select n, round(1.0/n,6) as inverse, round(1.0/sqrt(n),6) as inverse_sqrt, round(1.0/ln(n),6) as inverse_log from (select count(distinct question_id)::double as n from questions)")
def threshold_constants(spark, d):
    n = t(spark, d, "questions").agg(F.count_distinct("question_id").cast("double").alias("n"))
    return n.select("n", *(F.round(F.try_divide(F.lit(1.0), c), 6).alias(k) for k, c in (("inverse", F.col("n")), ("inverse_sqrt", F.sqrt("n")), ("inverse_log", F.ln("n")))))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
