"""Static tables: languages, recent files and figures of the front page (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id, label, emoji, color, ext.
LANGUAGES = (
    ("python", "Python", "🐍", "#d4f0e4", "py"),
    ("r", "R Code", "📊", "#f5f0ff", "R"),
    ("javascript", "JavaScript", "⚡", "#ffe8a3", "js"),
    ("typescript", "TypeScript", "🔷", "#ffe0d0", "ts"),
    ("java", "Java", "☕", "#ffd6e0", "java"),
    ("cpp", "C++", "⚙️", "#d0f0ff", "cpp"),
    ("sql", "SQL", "🗃️", "#e8d4f0", "sql"),
    ("kotlin", "Kotlin", "🟣", "#d4f0e4", "kt"),
)
#: Ord, nama, jenis, bahasa, status, tgl, ok.
RECENT_FILES = (
    (0, "laporan_keuangan_q4.pdf", "PDF", "Python", "Selesai", "24 Jun 2026", True),
    (1, "tutorial_analisis_data.docx", "DOCX", "R Code", "Selesai", "23 Jun 2026", True),
    (2, "spesifikasi_api_v2.pdf", "PDF", "JavaScript", "Selesai", "22 Jun 2026", True),
    (3, "panduan_backend.pdf", "PDF", "Java", "Gagal", "21 Jun 2026", False),
    (4, "skema_database.docx", "DOCX", "SQL", "Selesai", "20 Jun 2026", True),
)
#: Label, val, color.
STATS = (
    ("File Diproses", "1,247", "#d4f0e4"),
    ("Kode Diekstrak", "8,903", "#ffe8a3"),
    ("Bahasa Didukung", "8", "#f5f0ff"),
    ("Akurasi", "97.2%", "#ffe0d0"),
)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "id string, label string, emoji string, color string, ext string")


def recent_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RECENT_FILES, "ord int, nama string, jenis string, bahasa string, status string, tgl string, ok boolean"
    )


def stats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATS, "label string, val string, color string")
