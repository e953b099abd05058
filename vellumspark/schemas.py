"""Table schemas, and adapters that bring each source to the canonical one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_ARTICLES = "title string, url string, text string, summary string, categories array<string>, crawled_at string"
RAW_LEGAL = "doc_title string, doc_category string, doc_url string, doc_content string, crawled_at string"
TEXTBOOK_LESSONS = "title string, url string, text string, display_text string, categories array<string>, doc_type string, crawled_at string"
LAW_ARTICLES = "title string, url string, text string, categories array<string>, doc_type string, crawled_at string"
CHUNKS = "chunk_id string, doc_title string, doc_category string, vector_text string, display_text string, doc_url string, domain string, chunk_index int, has_math boolean, has_formula boolean, has_table boolean, has_list boolean, has_legal boolean, char_count int, word_count int"
VECTOR_POINTS = "id string, vector array<float>, payload struct<title:string,text:string,category:string,url:string,chunk_id:string>"
QUESTIONS = "qid string, question string, choices array<string>, answer string"
SUBMISSION = "qid string, answer string"
ROUTE = "is_unsafe boolean, is_stem boolean, use_large boolean, tag string, refusal_key string, refusal_type string"
CRAWL_STATE = "url_hash string, url string, category string, status string, crawled_at timestamp"


def from_legal(raw: DataFrame) -> DataFrame:
    """raw_legal rows as raw_articles rows."""
    return raw.select(
        F.col("doc_title").alias("title"),
        F.col("doc_url").alias("url"),
        F.col("doc_content").alias("text"),
        F.lit(None).cast("string").alias("summary"),
        F.array("doc_category").alias("categories"),
        "crawled_at",
    )


def from_documents(documents: DataFrame) -> DataFrame:
    """The documents table as raw_articles rows: title from the id, category path from lang and source."""
    return documents.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        F.substring("text", 1, 300).alias("summary"),
        F.array("lang", "source").alias("categories"),
        F.lit(None).cast("string").alias("crawled_at"),
    )


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Columns that a loaded index lacks."""
    return [c for c in needed if c not in df.columns]
