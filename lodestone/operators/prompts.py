"""Numbered sources, prompts and answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The texts of the prompt and of an answer without sources.
SYSTEM_PROMPT = (
    "Bạn là trợ lý y khoa nói tiếng Việt. Chỉ trả lời dựa trên các đoạn tài liệu được đánh số trong tin nhắn của người dùng. "
    "Sau mỗi ý lấy từ tài liệu, ghi số nguồn dạng [n]. "
    "Nếu tài liệu không đủ thông tin, hãy nói rõ là chưa có đủ thông tin, không tự suy đoán. "
    "Không chẩn đoán bệnh cho người dùng; khuyên đi khám bác sĩ khi triệu chứng nặng hoặc kéo dài."
)
NO_RESULT = "Không tìm thấy thông tin liên quan trong cơ sở dữ liệu."
DOCUMENTS, QUESTION = "Tài liệu:", "Câu hỏi:"
SOURCE_TYPE = "array<struct<n:int,title:string,url:string,section_path:string,type:string,text:string,score:double>>"


def number_sources(hits: DataFrame) -> DataFrame:
    """``n`` from 1 in the order of ``rank``, per question."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id")))


def sources_array(hits: DataFrame) -> DataFrame:
    """``question_id, sources``: the numbered hits as an array in order."""
    numbered = number_sources(hits).withColumn("score", F.col("score").cast("double"))
    fields = F.struct(F.col("n"), F.col("article_title").alias("title"), F.col("article_url").alias("url"), "section_path", "type", "text", "score")
    return numbered.groupBy("question_id").agg(F.array_sort(F.collect_list(fields)).alias("sources"))


def build_messages(question: Column, sources: Column) -> Column:
    """System and user message of the prompt."""

    def shown(s: Column) -> Column:
        head = F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), s["title"], F.lit(" — "), s["section_path"])
        return F.concat(head, F.lit("\n"), s["text"])

    user = F.concat(
        F.lit(f"{DOCUMENTS}\n"), F.array_join(F.transform(sources, shown), "\n\n"), F.lit(f"\n\n{QUESTION} "), question
    )
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user))


def answer_rows(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question: its sources, the prompt to send, or the fixed answer where nothing was found."""
    joined = questions.join(sources_array(hits), "question_id", "left")
    sources = F.coalesce("sources", F.array().cast(SOURCE_TYPE))
    filled = joined.withColumn("sources", sources)
    found = F.size("sources") > 0
    return filled.select(
        "question_id",
        "question",
        "sources",
        F.when(found, build_messages(F.col("question"), F.col("sources"))).alias("messages"),
        F.when(~found, F.lit(NO_RESULT)).alias("answer"),
    )
