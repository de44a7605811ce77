"""Answers from retrieved chunks: context, prompts, a client without a model, and the history."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import ERRORS, FAILED

# Messages and cuts.
NO_EVIDENCE = "未在已入库文档中找到依据。"
SYSTEM = '你是专业传感器技术文档检索问答助手。必须严格基于用户提供的【来源片段】回答。禁止使用来源片段之外的知识补充事实。如果来源不足，明确说"未在已入库文档中找到依据"。每条关键结论后必须标注来源编号，例如 [S1]。'
QUESTION, PASSAGES = "问题：", "【来源片段】"
WITHOUT_MODEL = ("未配置可用的大模型提供方（当前 LLM_PROVIDER=", "），无法生成自然语言回答。\n\n已完成本地检索，请根据下方来源片段核对：\n")
CONTEXT_CHARS, FALLBACK_CHARS = 1800, 1200
EMPTY, CHECK_SOURCES, ANSWERING = "（模型未返回内容）", "已返回本地检索来源，请人工核对。", "大模型问答"


class Client(Protocol):
    """A language model: messages (role, content) in, pieces of the answer out."""

    def chat(self, messages: list[dict[str, str]]) -> Iterator[str]: ...


def fallback_answer(user: Column, provider: str = "crs") -> Column:
    """What is answered without a model: a fixed message and the beginning of the user's message."""
    return F.concat(F.lit(WITHOUT_MODEL[0] + provider + WITHOUT_MODEL[1]), F.substring(user, 1, FALLBACK_CHARS))


class NoModel:
    """The client that needs no model."""

    def __init__(self, provider: str = "crs"):
        self.provider = provider

    def chat(self, messages: list[dict[str, str]]) -> Iterator[str]:
        user = messages[-1]["content"] if messages else ""
        yield WITHOUT_MODEL[0] + self.provider + WITHOUT_MODEL[1] + user[:FALLBACK_CHARS]


def context(results: DataFrame) -> DataFrame:
    """One row (context) of ranked results (rank, source, page_number, chunk_id, content), which are at most k."""
    page = F.when(F.col("page_number") != 0, F.concat(F.lit(" p."), F.col("page_number").cast("string"))).otherwise(F.lit(""))
    part = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.col("source"), page, F.lit("\nchunk_id="), F.col("chunk_id"), F.lit("\n"), F.substring("content", 1, CONTEXT_CHARS))
    rows = results.agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("context"))


def user_message(question: Column, passages: Column) -> Column:
    return F.concat(F.lit(QUESTION), question, F.lit(f"\n\n{PASSAGES}\n"), passages)


def messages(question: str, passages: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"{QUESTION}{question}\n\n{PASSAGES}\n{passages}"}]


def sources_json(results: DataFrame) -> DataFrame:
    """One row (sources_json): the results that an answer rests on, in order."""
    item = F.struct("chunk_id", "document_id", "source", "page_number", "score")
    rows = results.agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("r"))
    return rows.select(F.to_json(F.transform("r", lambda x: x["item"]), {"ignoreNullFields": "false"}).alias("sources_json"))


def answer_stream(question: str, results: DataFrame, client: Client) -> Iterator[str]:
    """Pieces of the answer to a question from its ranked results, of which at most k are collected."""
    rows = context(results).first()
    if not rows or not rows.context:
        yield NO_EVIDENCE
        return
    said = False
    try:
        for piece in client.chat(messages(question, rows.context)):
            said = said or bool(piece)
            yield piece
    except Exception as error:  # a client may fail in any way; the reader is told
        said = True
        yield f"\n\n{_classified(str(error))}\n\n{CHECK_SOURCES}"
    if not said:
        yield EMPTY


def _classified(message: str) -> str:
    """reports.error_class of one message, on the driver."""
    heading = next((h for h, words in ERRORS if any(w in message.lower() for w in words)), ANSWERING + FAILED)
    return f"{heading}：{message}"


def answer(question: str, results: DataFrame, client: Client) -> str:
    return "".join(answer_stream(question, results, client))


def history_row(question: str, text: str, results: DataFrame) -> DataFrame:
    """The row that is appended to the query history."""
    return sources_json(results).select(F.lit(question).alias("query"), F.lit("qa").alias("query_type"), F.lit(text).alias("answer"), "sources_json", F.current_timestamp().alias("created_at"))
