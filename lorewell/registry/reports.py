"""Registered queries: conversations, feedback, quality, usage, catalog, rate limits, evaluation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from lorewell.operators import dialogue as D
from lorewell.operators import evaluate as E
from lorewell.operators import quality, ratelimit
from lorewell.operators import usage as U
from lorewell.registry import views as V
from lorewell.registry.core import query
from lorewell.registry.sources_and_text import sql_blank, sql_trim
from lorewell.scale import side_by_side
from lorewell.sources import tables
from lorewell.streaming import jobs, windows

NOW = "2024-04-20"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("recent_answers", V.with_views("""
    select session, rank, id from (select session, id, row_number() over (partition by session order by created_time desc, id desc) rank from v_answers) where rank <= 6""",
    "v_answers"))
def recent_answers(spark, sf):
    return D.recent_answers(V.answers(spark, sf)).select("session", "rank", "id")


@query("pair_turns", V.with_views("""
    select conversation_id, ord, content question, next_content answer from (select *, lead(role) over w next_role, lead(content) over w next_content from v_messages
        window w as (partition by conversation_id order by ord)) where role = 'USER' and next_role = 'ASSISTANT'""", "v_messages"))
def pair_turns(spark, sf):
    return D.pair_turns(V.messages(spark, sf), slice_messages=2)


@query("thread_view", V.with_views("""
    select m.conversation_id, m.ord, m.role, a.confidence from v_messages m left join v_answers a on a.id = case when m.role = 'ASSISTANT' then m.conversation_id end""",
    "v_messages", "v_answers"))
def thread_view(spark, sf):
    messages = V.messages(spark, sf).withColumn("chat_history_id", F.when(F.col("role") == "ASSISTANT", F.col("conversation_id")))
    return D.thread_view(messages, V.answers(spark, sf)).select("conversation_id", "ord", "role", "confidence")


@query("conversation_titles", V.with_views(f"""
    select conversation_id, coalesce(case when length(f) <= 30 then f else concat(substr(f, 1, 30), '…') end, '新对话') title from (
        select conversation_id, {sql_trim("arg_min(content, ord) filter (role = 'USER')")} f from v_messages group by 1)""", "v_messages"))
def conversation_titles(spark, sf):
    return D.conversation_titles(V.messages(spark, sf))


@query("sources_json", """
    select event_id, case when event_type = 'view' then '[]' else concat('[{"title":"', event_type, '","type":null,"page":', cast(user_id as varchar),
        ',"score":0.5,"source":"s","url":null,"category":"LIFE"}]') end sources from events""")
def sources_json(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "view", F.lit(" ")).otherwise(F.concat(
        F.lit('[{"source":"s","title":"'), kind, F.lit('","page":'), F.col("user_id").cast("string"), F.lit(',"category":"LIFE","score":0.5,"extra":1}]')))
    return V.table(spark, sf, "events").select("event_id", D.sources_to_json(D.sources_from_json(text)).alias("sources"))


def _conversations(spark, sf):
    """One conversation per user; it expires 90 days after the user's last event."""
    last = V.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_time"))
    return last.select(
        F.col("user_id").alias("conversation_id"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 1).alias("anonymous_session_id"),
        "updated_time", (F.col("updated_time") + F.make_dt_interval(F.lit(80))).alias("expire_time"))


_CONV_SQL = """conv as (select user_id conversation_id, substr(sha256(cast(user_id as varchar)), 1, 1) session, max(ts) + interval 80 day expire_time from events group by 1)"""


@query("visible_conversations", f"with {_CONV_SQL} select conversation_id from conv where session = 'a' and expire_time >= timestamp '2024-04-19 12:00:00'")
def visible_conversations(spark, sf):
    return D.visible_conversations(_conversations(spark, sf), F.lit("a"), F.lit("2024-04-19 12:00:00").cast("timestamp_ntz")).select("conversation_id")


@query("retention_cleanup", f"""
    with {_CONV_SQL}, gone as (select conversation_id from conv where expire_time < timestamp '2024-04-19 12:00:00')
    select 'conversation' part, conversation_id id from conv where conversation_id not in (select * from gone)
    union all select 'message', event_id from events where event_type = 'view' and user_id not in (select * from gone)
    union all select 'answer', event_id from events where event_type <> 'view' and case when event_type = 'click' then ts >= timestamp '2024-04-19 12:00:00' - interval 90 day
        else user_id not in (select * from gone) end
    union all select 'expired', count(*) from gone""")
def retention_cleanup(spark, sf):
    events = V.table(spark, sf, "events")
    messages = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("conversation_id"))
    answers = events.where("event_type <> 'view'").select(
        "event_id", F.when(F.col("event_type") != "click", F.col("user_id")).alias("conversation_id"), F.col("ts").alias("created_time"))
    live, kept, rest, count = D.retention_cleanup(
        _conversations(spark, sf), messages, answers, F.lit("2024-04-19 12:00:00").cast("timestamp_ntz"))
    parts = [live.select(F.lit("conversation").alias("part"), F.col("conversation_id").alias("id")),
             kept.select(F.lit("message").alias("part"), F.col("event_id").alias("id")),
             rest.select(F.lit("answer").alias("part"), F.col("event_id").alias("id")),
             count.select(F.lit("expired").alias("part"), F.col("expired_count").alias("id"))]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_UUID = "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


@query("session_id", f"""
    select event_id, case when event_type in ('view', 'click') then {_UUID.format(h="sha256(cast(user_id as varchar))")} end session from events""")
def session_id(spark, sf):
    h = F.sha2(F.col("user_id").cast("string"), 256)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = F.col("event_type")
    text = F.when(kind == "view", F.concat(F.lit(" "), F.upper(uuid), F.lit("\n"))).when(kind == "click", uuid) \
        .when(kind == "signup", F.substring(uuid, 1, 35)).when(kind == "purchase", F.lit("  "))
    return V.table(spark, sf, "events").select("event_id", D.session_id(text).alias("session"))


@query("feedback_upsert", V.with_views("""
    select chat_history_id, case when event_type = 'purchase' then 'HELPFUL' else 'INCORRECT' end user_feedback, case when event_type = 'view' then null else event_type end reason
    from (select e.event_id seq, a.id chat_history_id, e.event_type, row_number() over (partition by a.id order by e.event_id desc) rn
        from events e join v_answers a on a.id = e.user_id where e.event_type <> 'error') where rn = 1""", "v_answers"))
def feedback_upsert(spark, sf):
    kind = F.col("event_type")
    owners = V.answers(spark, sf).select(F.col("id").alias("user_id"), "session")
    events = V.table(spark, sf, "events").join(owners, "user_id").select(
        F.col("user_id").alias("chat_history_id"), F.when(kind == "error", "intruder").otherwise(F.col("session")).alias("session"),
        F.when(kind == "purchase", "HELPFUL").otherwise("INCORRECT").alias("feedback"),
        F.when(kind == "view", "\t").otherwise(F.concat(F.lit(" "), kind)).alias("reason"), F.col("event_id").alias("seq"))
    return D.feedback_upsert(events, V.answers(spark, sf))


@query("quality_totals", V.with_views("""
    select total_answers, unique_sessions, low_confidence_answers, helpful, incorrect, low_confidence_incorrect, helpful + incorrect feedback_count,
        floor(helpful * 100.0 / (helpful + incorrect) * 10 + 0.5) / 10.0::double helpful_rate
    from (select count(*) total_answers, count(distinct session) unique_sessions, count(*) filter (confidence < 70) low_confidence_answers from v_answers),
        (select count(*) filter (user_feedback = 'HELPFUL') helpful, count(*) filter (user_feedback = 'INCORRECT') incorrect from v_feedback),
        (select count(*) low_confidence_incorrect from v_answers join v_feedback on chat_history_id = id where confidence < 70 and user_feedback = 'INCORRECT')""",
    "v_answers", "v_feedback"))
def quality_totals(spark, sf):
    return quality.quality_totals(V.answers(spark, sf), V.feedback(spark, sf))


@query("frequent_questions", V.with_views(f"""
    select {sql_trim('question')} question, count(*) occurrences from v_answers group by 1 order by 2 desc, 1 limit 10""", "v_answers"))
def frequent_questions(spark, sf):
    return quality.frequent_questions(V.answers(spark, sf))


@query("frequent_questions_approximate", None)
def frequent_questions_approximate(spark, sf):
    return quality.frequent_questions_approximate(V.answers(spark, sf))


@query("low_quality_questions", V.with_views(f"""
    select {sql_trim('question')} question, count(*) occurrences, count(*) filter (user_feedback = 'INCORRECT') incorrect_count,
        floor(avg(coalesce(confidence, 0)) * 10 + 0.5) / 10.0::double average_confidence
    from v_answers left join v_feedback on chat_history_id = id where coalesce(confidence < 70, false) or coalesce(user_feedback = 'INCORRECT', false)
    group by 1 order by 3 desc, 2 desc, 1 limit 10""", "v_answers", "v_feedback"))
def low_quality_questions(spark, sf):
    return quality.low_quality_questions(V.answers(spark, sf), V.feedback(spark, sf))


@query("feedback_counts", V.with_views("select user_feedback, count(*) n from v_feedback group by 1", "v_feedback"))
def feedback_counts(spark, sf):
    return quality.feedback_counts(V.feedback(spark, sf))


def _usage_sql(condition: str, period: str) -> str:
    return V.with_views(f"""
    select '{period}' period, count(*) requests, count(*) filter (status = 'SUCCESS') successes, count(*) filter (status = 'FAILED') failures,
        cast(coalesce(sum(prompt_tokens), 0) as bigint) prompt_tokens, cast(coalesce(sum(completion_tokens), 0) as bigint) completion_tokens,
        cast(coalesce(sum(total_tokens), 0) as bigint) total_tokens, cast(coalesce(sum(cache_hit_tokens), 0) as bigint) cache_hit_tokens,
        cast(coalesce(sum(cache_miss_tokens), 0) as bigint) cache_miss_tokens,
        case when count(*) = 0 then 0 else floor(count(*) filter (status = 'SUCCESS') * 100.0::double / count(*) * 100 + 0.5) / 100 end::double success_rate,
        (floor((coalesce(sum(prompt_tokens), 0) * 0.27::double / 1000000 + coalesce(sum(completion_tokens), 0) * 1.1::double / 1000000) * 1000000 + 0.5) / 1000000)::double estimated_cost
    from v_usage where {condition}""", "v_usage")


def _usage(period):
    def build(spark, sf):
        return U.usage_summary(V.usage(spark, sf), period, F.lit("2024-01-30").cast("date"), 0.27, 1.1)
    return build


for _period, _condition in (("today", "created_time >= timestamp '2024-01-30'"), ("7d", "created_time >= timestamp '2024-01-24'"),
                            ("30d", "created_time >= timestamp '2024-01-01'"), ("all", "true")):
    query(f"usage_summary_{_period}", _usage_sql(_condition, _period))(_usage(_period))


@query("period_start", """
    select event_id, cast(ts + interval 8 hour as date) report_day, cast(ts + interval 8 hour as date) - 6 week_start, cast(ts + interval 8 hour as date) - 29 month_start from events""")
def period_start(spark, sf):
    day = U.report_day(F.col("ts"))
    return V.table(spark, sf, "events").select(
        "event_id", U.period_start("someday", day).alias("report_day"), U.period_start(" 7D ", day).alias("week_start"),
        U.period_start("30d", day).alias("month_start"))


@query("estimated_cost", V.with_views("""
    select id, floor((prompt_tokens * 0.27::double / 1000000 + completion_tokens * 0::double / 1000000) * 1000000 + 0.5) / 1000000::double cost from v_usage""", "v_usage"))
def estimated_cost(spark, sf):
    return V.usage(spark, sf).select("id", U.estimated_cost(F.col("prompt_tokens"), F.col("completion_tokens"), 0.27, -5).alias("cost"))


@query("sanitize_usage", V.with_views("""
    select id, case when model = 'view' then '' else model end model, greatest(0, prompt_tokens - 100) prompt_tokens, greatest(0, coalesce(case when model <> 'click' then completion_tokens end, 0)) completion_tokens,
        case when status = 'FAILED' then case when prompt_tokens < 250 then 'UNKNOWN' else concat('HTTP_500____', repeat('X', 52)) end end error_type from v_usage""", "v_usage"))
def sanitize_usage(spark, sf):
    rows = V.usage(spark, sf)
    dirty = rows.withColumns({
        "model": F.when(F.col("model") != "view", F.col("model")),
        "completion_tokens": F.when(F.col("model") != "click", F.col("completion_tokens")),
        "prompt_tokens": F.col("prompt_tokens") - 100,
        "error_type": F.when(F.col("prompt_tokens") >= 250, F.concat(F.lit("HTTP 500: é"), F.lit("_"), F.repeat(F.lit("X"), F.lit(80))))})
    return U.sanitize_usage(dirty).select("id", "model", "prompt_tokens", "completion_tokens", "error_type")


@query("audit_latest", f"""
    select doc_id id, substr({sql_trim('text')}, 1, 64) operation, substr({sql_trim('text')}, 1, 1000) target from documents order by n_chars desc, doc_id desc limit 100""")
def audit_latest(spark, sf):
    log = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("operation"), F.col("text").alias("target"), F.col("n_chars").alias("created_time"))
    return quality.audit_latest(log).drop("created_time")


@query("catalog_search", V.with_views("""
    select id from v_catalog where contains(lower(concat(title, source, filename)), 'src1') and category = 'LIFE'""", "v_catalog"))
def catalog_search(spark, sf):
    return quality.catalog_search(V.catalog(spark, sf), "SRC1", "校园生活").select("id")


@query("catalog_admin_search", V.with_views("""
    select id from v_catalog where contains(lower(concat(filename, source, case category when 'LIFE' then 'LIFE校园生活' when 'MAJOR' then 'MAJOR专业培养'
        when 'CAREER' then 'CAREER就业发展' else '未分类' end)), 'src1未')""", "v_catalog"))
def catalog_admin_search(spark, sf):
    return quality.catalog_admin_search(V.catalog(spark, sf), " SRC1未 ").select("id")


@query("catalog_metrics", V.with_views("""
    select count(*) documents, count(distinct source) sources, count(*) filter (status = 'COMPLETED') completed,
        count(*) filter (status in ('PROCESSING', 'UPLOADING')) processing, count(*) filter (status = 'FAILED') failed from v_catalog""", "v_catalog"))
def catalog_metrics(spark, sf):
    return quality.catalog_metrics(V.catalog(spark, sf))


DAY = 86_400_000_000
RATE_LIMITS = {"chat_ip": 60, "chat_session": 3, "admin_ip": 20, "login_ip": 50}


def requests(spark, sf):
    """Events as requests: users share few addresses, errors are admin calls, sign-ups log in."""
    kind = F.col("event_type")
    path = F.when(kind == "error", "/api/admin/documents").when(kind == "signup", "/api/admin/auth/login").when(
        kind == "purchase", "/health").otherwise("/api/chat/ask")
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts", path.alias("path"), F.lit("10.0.0.1").alias("ip"),
        F.when(kind == "view", F.col("user_id").cast("string")).otherwise(" ").alias("session"))


# One recursion step per request of a bucket; levels are whole numbers as in the operator.
_BUCKETS_SQL = f"""
    with recursive req as (select event_id id, epoch_us(ts) t, case event_type when 'error' then 'admin' when 'signup' then 'login' when 'purchase' then 'free' else 'chat' end grp,
        case event_type when 'error' then 20 when 'signup' then 50 else 60 end cap, case when event_type = 'view' then cast(user_id as varchar) end session from events),
    seq as (select *, row_number() over (partition by grp order by t, id) rn from req where grp <> 'free'),
    walk as (select grp, rn, id, t, cap, cast(cap * {DAY} - {DAY} as bigint) level, true ok from seq where rn = 1
        union all select s.grp, s.rn, s.id, s.t, s.cap, cast(least(s.cap * {DAY}, w.level + s.cap * (s.t - w.t)) - case when least(s.cap * {DAY}, w.level + s.cap * (s.t - w.t)) >= {DAY} then {DAY} else 0 end as bigint),
            least(s.cap * {DAY}, w.level + s.cap * (s.t - w.t)) >= {DAY} from walk w join seq s on s.grp = w.grp and s.rn = w.rn + 1),
    sseq as (select r.*, row_number() over (partition by r.session order by r.t, r.id) rn from req r join walk w using (id) where w.ok and r.session is not null),
    swalk as (select session, rn, id, t, cast(3 * {DAY} - {DAY} as bigint) level, true ok from sseq where rn = 1
        union all select s.session, s.rn, s.id, s.t, cast(least(3 * {DAY}, w.level + 3 * (s.t - w.t)) - case when least(3 * {DAY}, w.level + 3 * (s.t - w.t)) >= {DAY} then {DAY} else 0 end as bigint),
            least(3 * {DAY}, w.level + 3 * (s.t - w.t)) >= {DAY} from swalk w join sseq s on s.session = w.session and s.rn = w.rn + 1)
    select r.id request_id, coalesce(w.ok, true) and coalesce(s.ok, true) allowed from req r left join walk w using (id) left join swalk s using (id)"""


@query("rate_limit_replay", _BUCKETS_SQL)
def rate_limit_replay(spark, sf):
    """Limits per day instead of per minute, so that the sparse events run into them."""
    return ratelimit.rate_limit_replay(requests(spark, sf), RATE_LIMITS, DAY, slice_micros=DAY // 2).select("request_id", "allowed")


# --- evaluation ------------------------------------------------------------------------------

_POINTS = "cast((case when has_source then 35 else 0 end + case when source_match then 30 else 0 end + case when keyword_match then 25 else 0 end + case when non_empty then 10 else 0 end) as int)"


def _results(spark, sf):
    return E.score_answers(*V.evaluation(spark, sf)).withColumn("id", F.col("question_id")).withColumn("run_id", F.lit("r1"))


@query("score_answers", V.with_views(f"select id, has_source, source_match, keyword_match, non_empty, {_POINTS} score from v_scored", "v_scored"))
def score_answers(spark, sf):
    return _results(spark, sf).select("id", "has_source", "source_match", "keyword_match", "non_empty", "score")


def _reviewed(spark, sf):
    """Results of two runs (English and the rest) with the quality label as human review."""
    reviews = V.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("accurate"), F.when(F.col("toxic") == 1, " ").otherwise(" seen ").alias("note"))
    results = _results(spark, sf).withColumns({
        "run_id": F.when(F.col("category") == "en", "r1").otherwise("r2"), "human_accurate": F.lit(None).cast("boolean"),
        "review_note": F.lit("old")})
    return E.apply_reviews(results, reviews)


_RUNS = f"runs as (select *, {_POINTS} score, case when category = 'en' then 'r1' else 'r2' end run_id, case when labelled then quality = 1 end human_accurate from v_scored)"
_RATE = "floor(count(*) filter ({c}) * 100.0::double / {t} * 10 + 0.5) / 10"
_REPORT = f"""report as (select run_id, count(*) total, floor(avg(score) * 10 + 0.5) / 10 average_score, {_RATE.format(c='has_source', t='count(*)')} source_coverage,
    {_RATE.format(c='source_match', t='count(*)')} source_match_rate, {_RATE.format(c='keyword_match', t='count(*)')} keyword_match_rate,
    {_RATE.format(c='non_empty', t='count(*)')} non_empty_rate, count(human_accurate) reviewed, {_RATE.format(c='human_accurate', t='nullif(count(human_accurate), 0)')} human_accuracy_rate
    from runs group by 1)"""


@query("eval_report", V.with_views(f", {_RUNS}, {_REPORT} select * from report", "v_scored"))
def eval_report(spark, sf):
    return E.eval_report(_reviewed(spark, sf))


@query("report_by_run", V.with_views(f", {_RUNS}, {_REPORT} select * from report where run_id = 'r2'", "v_scored"))
def report_by_run(spark, sf):
    return E.report_by_run(_reviewed(spark, sf), "r2")


@query("category_scores", V.with_views(f", {_RUNS} select run_id, category, floor(avg(score) * 10 + 0.5) / 10 average_score, min(id) first_id from runs group by 1, 2", "v_scored"))
def category_scores(spark, sf):
    return E.category_scores(_reviewed(spark, sf))


@query("gates", V.with_views(f"""
    , {_RUNS}, {_REPORT}, listed as (select run_id, concat_ws(';', case when non_empty_rate < 98 then '非空率低于 98%' end, case when source_coverage < 95 then '来源覆盖率低于 95%' end,
        case when source_match_rate < 85 then '来源匹配率低于 85%' end, case when human_accuracy_rate is null then '人工准确率尚未完成复核' when human_accuracy_rate < 90 then '人工准确率低于 90%' end) failures from report)
    select run_id, failures, failures = '' passed from listed""", "v_scored"))
def gates(spark, sf):
    return E.gates(E.eval_report(_reviewed(spark, sf))).select("run_id", F.array_join("gate_failures", ";").alias("failures"), "passed")


@query("apply_reviews", V.with_views("""
    select id, case when labelled then quality = 1 end human_accurate, case when not labelled then 'old' when toxic = 1 then null else 'seen' end review_note from v_scored""", "v_scored"))
def apply_reviews(spark, sf):
    return _reviewed(spark, sf).select("id", "human_accurate", "review_note")


@query("question_distribution", "select lang category, count(*) n from documents group by 1")
def question_distribution(spark, sf):
    return E.question_distribution(V.evaluation(spark, sf)[0])


# --- batch twins of the streams --------------------------------------------------------------

@query("usage_per_day", V.with_views("""
    select date_trunc('day', created_time) usage_day, model, count(*) requests, count(*) filter (status = 'SUCCESS') successes, cast(sum(total_tokens) as bigint) total_tokens
    from v_usage group by 1, 2""", "v_usage"))
def usage_per_day(spark, sf):
    rows = windows.usage_per_window(V.usage(spark, sf), "1 day", ["model"])
    return rows.select(F.col("window_start").alias("usage_day"), "model", "requests", "successes", "total_tokens")


@query("session_activity", """
    with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end starts from events),
    grouped as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) grp from marked)
    select cast(user_id as varchar) session, min(ts) first_seen, max(ts) + interval 12 hour expires, count(*) messages from grouped group by user_id, grp""")
def session_activity(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("created_time"))
    return windows.session_activity(rows, timedelta(hours=12))


@query("catalog_detail", V.with_views("select id, sha256(content) digest from v_catalog where id = 7", "v_catalog"))
def catalog_detail(spark, sf):
    return tables.catalog_detail(V.catalog(spark, sf), 7).select("id", F.sha2("content", 256).alias("digest"))


@query("session_history", V.with_views("""
    select id, created_time from v_answers where session = (select min(session) from v_answers) order by created_time desc, id desc""", "v_answers"))
def session_history(spark, sf):
    answers = V.answers(spark, sf)
    first = answers.agg(F.min("session")).first()[0]
    return D.session_history(answers, first).select("id", "created_time")


@query("quality_totals_approximate", V.with_views("select count(*) total_answers, true near from v_answers", "v_answers"))
def quality_totals_approximate(spark, sf):
    """The sketch of the session count stays within a tenth of the exact one."""
    answers, feedback = V.answers(spark, sf), V.feedback(spark, sf)
    exact = answers.agg(F.count_distinct("session").alias("exact"))
    rough = quality.quality_totals(answers, feedback, approximate=True)
    both = side_by_side(rough.select("total_answers", "unique_sessions"), exact)
    return both.select("total_answers", (F.abs(F.col("unique_sessions") - F.col("exact")) * 10 <= F.col("exact")).alias("near"))


@query("dedupe_pages", "select url, content_hash, count(*) n from (select distinct url, sha256(html) content_hash from pages) group by all")
def dedupe_pages(spark, sf):
    """The batch twin of the page stream that drops repeats: every page arrives twice."""
    pages = V.table(spark, sf, "pages").select("url", F.sha2("html", 256).alias("content_hash"))
    return jobs.stream_dedupe(pages.union(pages)).groupBy("url", "content_hash").agg(F.count("*").alias("n"))
