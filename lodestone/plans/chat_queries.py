"""Queries: prompts, answer rows and chat logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import bm25, chat, chatlog, prompts
from lodestone.operators.embed import CallPolicy
from lodestone.plans.bindings import messages, passages, questions, sql
from lodestone.plans.search_queries import POSTINGS_SQL, sparse_index
from lodestone.sources.tables import materialised, scratch

#: Ten days after the first conversation of the log.
NOW_MS = 1_700_000_000_000 + 864_000_000


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and BM25 hits of all of them with their chunks."""
    chunks, asked = materialised(passages(spark, sf_dir), "chunks"), questions(spark, sf_dir)
    top = bm25.sparse_topk(asked, *sparse_index(chunks))
    full = top.select("question_id", "chunk_id", "rank").join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")
    return asked, full.withColumn("score", F.lit(None).cast("double"))


def number_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _hits(spark, sf_dir)
    return prompts.number_sources(hits).select("question_id", "n", "chunk_id")


def sources_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered sources of each question, as titles in order."""
    _, hits = _hits(spark, sf_dir)
    shown = F.transform("sources", lambda s: F.concat_ws(":", s["n"], s["title"], s["url"]))
    return prompts.sources_array(hits).select("question_id", F.array_join(shown, ",").alias("sources"))


def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    rows = prompts.answer_rows(asked, hits).where(F.col("messages").isNotNull())
    return rows.select("question_id", F.get("messages", F.lit(1))["content"].alias("prompt"))


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return prompts.answer_rows(asked, hits).select("question_id", "question", F.size("sources").alias("n_sources"), "answer")


def _chat():
    """A small deterministic model: it says how many sources it was given, and fails where there are four."""

    def chat(sent):
        prompt = sent[1]["content"]
        n = prompt.count("[Chủ đề: ")
        if n == 4:
            raise TimeoutError("four")
        return f"{n} sources [1]"

    return chat


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's answer by an injected model, the fixed one where nothing was found, and whether the call failed."""
    asked, hits = _hits(spark, sf_dir)
    rows = materialised(prompts.answer_rows(asked, hits), "answer-rows")
    answered = chat.chat_answers(rows, _chat, scratch(spark, "ledger"), policy=CallPolicy(attempts=2, pause=0.01))
    return answered.select("question_id", "answer", F.col("error").isNotNull().alias("failed"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("role = 'assistant'")


def assemble_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one more question in every third conversation and in new ones."""
    log = messages(spark, sf_dir)
    asked = log.where("turn = 0 and conv_id % 3 = 0").select(
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).otherwise(-F.col("conv_id") - 1).alias("conv_id"), F.lit("And now?").alias("text"), (F.col("created_at") + 9).alias("created_at")
    )
    turns = chatlog.assemble_turns(log, asked)
    return turns.select("conv_id", "turn", "role", F.length("text").alias("n_chars"), "created_at", "pending")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.conversations_of(messages(spark, sf_dir))


def apply_answer_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = messages(spark, sf_dir).select("conv_id", "turn", "msg_id", "role", "text")
    known = log.where("turn = 1 and conv_id % 3 = 0").select("conv_id", "msg_id", F.lit("patched").alias("text"))
    unknown = known.select("conv_id", F.concat("msg_id", F.lit("?")).alias("msg_id"), "text")
    return chatlog.apply_patches(log, known.unionByName(unknown))


def citation_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.citation_usage(_answers(spark, sf_dir))


def group_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = chatlog.group_by_day(chatlog.conversations_of(messages(spark, sf_dir)), NOW_MS)
    return days.select("conv_id", "day", "position")


def sources_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = messages(spark, sf_dir)
    selected = log.where("turn = 1 and conv_id % 2 = 0").select("conv_id", "msg_id")
    return chatlog.sources_for(log, selected).select("conv_id", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


QUERIES = {
    "number_sources": number_sources,
    "sources_array": sources_array,
    "build_messages": build_messages,
    "answer_rows": answer_rows,
    "chat_answers": chat_answers,
    "assemble_turns": assemble_turns,
    "conversations": conversations,
    "apply_answer_patches": apply_answer_patches,
    "citation_usage": citation_usage,
    "group_by_day": group_by_day,
    "sources_for": sources_for,
}

HITS_SQL = POSTINGS_SQL + """,
hits AS (SELECT question_id, chunk_id, rank AS n, article_title, article_url, section_path, text
  FROM sparse JOIN chunks ON id = chunk_id WHERE rank <= 5)"""

SQL = {
    "number_sources": sql(HITS_SQL + " SELECT question_id, n, chunk_id FROM hits"),
    "sources_array": sql(HITS_SQL + " SELECT question_id, string_agg(n || ':' || article_title || ':' || article_url, ',' ORDER BY n) AS sources FROM hits GROUP BY question_id"),
    "build_messages": sql(
        HITS_SQL
        + """ SELECT question_id, 'Tài liệu:' || chr(10) || string_agg('[' || n || '] ' || article_title || ' — ' || section_path || chr(10) || text, chr(10) || chr(10) ORDER BY n)
        || chr(10) || chr(10) || 'Câu hỏi: ' || any_value(question) AS prompt FROM hits JOIN questions USING (question_id) GROUP BY question_id"""
    ),
    "answer_rows": sql(
        HITS_SQL
        + f""" SELECT q.question_id, question, count(n)::INT AS n_sources, CASE WHEN count(n) = 0 THEN '{prompts.NO_RESULT}' END AS answer
        FROM questions q LEFT JOIN hits USING (question_id) GROUP BY ALL"""
    ),
    "chat_answers": sql(
        HITS_SQL
        + f""" SELECT q.question_id, CASE count(n) WHEN 0 THEN '{prompts.NO_RESULT}' WHEN 4 THEN NULL ELSE count(n) || ' sources [1]' END AS answer,
        count(n) = 4 AS failed FROM questions q LEFT JOIN hits USING (question_id) GROUP BY ALL"""
    ),
    "assemble_turns": sql(
        """CTE asked AS (SELECT CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE -conv_id - 1 END AS conv_id, created_at + 9 AS created_at FROM messages WHERE turn = 0 AND conv_id % 3 = 0),
        placed AS (SELECT a.conv_id, a.created_at, coalesce(last, -1) + 1 AS turn FROM asked a LEFT JOIN (SELECT conv_id, max(turn) AS last FROM messages GROUP BY conv_id) USING (conv_id))
        SELECT conv_id, turn, role, length(text)::INT AS n_chars, created_at, false AS pending FROM messages
        UNION ALL SELECT conv_id, turn, 'user', 8, created_at, false FROM placed UNION ALL SELECT conv_id, turn + 1, 'assistant', 0, created_at, true FROM placed"""
    ),
    "conversations": sql(
        r"""SELECT conv_id, CASE WHEN length(p) > 40 THEN substr(p, 1, 40) || '…' ELSE p END AS title, created_at, n_messages FROM (
        SELECT conv_id, regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g') AS p, min(created_at) AS created_at, count(*) AS n_messages FROM messages GROUP BY conv_id)"""
    ),
    "apply_answer_patches": sql("SELECT conv_id, turn, msg_id, role, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'patched' ELSE text END AS text FROM messages"),
    "citation_usage": sql(
        r"""SELECT msg_id, len(cited)::INT AS n_cites, len(list_distinct(cited))::INT AS n_cited_sources, (len(marks) - len(cited))::INT AS n_out_of_range,
        (source_count - len(list_distinct(cited)))::INT AS n_uncited FROM (SELECT msg_id, source_count, marks, list_filter(marks, lambda x: x BETWEEN 1 AND source_count) AS cited
        FROM (SELECT *, list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: x::INT) AS marks FROM messages WHERE role = 'assistant'))"""
    ),
    "group_by_day": sql(
        f"""SELECT conv_id, day, row_number() OVER (PARTITION BY day ORDER BY created_at DESC, conv_id)::INT AS position FROM (SELECT conv_id, min(created_at) AS created_at,
        CASE WHEN min(created_at) >= {NOW_MS // 86_400_000 * 86_400_000} THEN 'today' ELSE 'previous' END AS day FROM messages GROUP BY conv_id)"""
    ),
    "sources_for": sql(
        """SELECT conv_id, coalesce(any_value(source_count) FILTER (turn = 1 AND conv_id % 2 = 0 AND role = 'assistant' AND source_count > 0),
        arg_max(source_count, turn) FILTER (role = 'assistant' AND source_count > 0), 0)::INT AS n_sources FROM messages GROUP BY conv_id"""
    ),
}
