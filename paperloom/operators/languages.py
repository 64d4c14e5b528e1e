"""The language dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas

#: Name (also in English), name in Persian, abbreviation.
LANGUAGES = [
    ("English", "انگلیسی", "en"),
    ("Persian", "فارسی", "fa"),
    ("Arabic", "عربی", "ar"),
    ("Turkish", "ترکی", "tr"),
    ("French", "فرانسه", "fr"),
    ("Spanish", "اسپانیایی", "es"),
    ("German", "آلمانی", "de"),
    ("Italian", "ایتالیایی", "it"),
    ("Portuguese", "پرتغالی", "pt"),
    ("Dutch", "هالندی", "nl"),
    ("Russian", "روسی", "ru"),
    ("Polish", "لهستانی", "pl"),
    ("Romanian", "رومانیایی", "ro"),
    ("Bulgarian", "بلغاری", "bg"),
    ("Hungarian", "مجارستانی", "hu"),
    ("Czech", "چک", "cs"),
    ("Greek", "یونانی", "el"),
    ("Hebrew", "عبری", "he"),
    ("Japanese", "ژاپنی", "ja"),
    ("Korean", "کره ای", "ko"),
    ("Mandarin", "چینی ماندارین", "cmn"),
    ("Vietnamese", "ویتنامی", "vi"),
    ("Indonesian", "اندونزیایی", "id"),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, fa, name, short) for name, fa, short in LANGUAGES], schemas.LANGUAGES)


def with_language(rows: DataFrame, abbreviation: str) -> DataFrame:
    """Rows with the language's attributes, null for unknown abbreviations. The dimension has a fixed, small size."""
    table = languages(rows.sparkSession).select(F.col("abbreviation").alias(abbreviation), F.col("value").alias("language_value"), F.col("fa").alias("language_fa"))
    return rows.join(F.broadcast(table), abbreviation, "left")
