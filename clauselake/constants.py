"""Vocabularies, limits, patterns and labels.

They are part of the data contract (stored rows and outbound requests depend on
them), so they are listed here once and passed as defaults everywhere else.
"""

# --- fixed values: vocabularies ---------------------------------------------
SEVERITIES = ["critical", "high", "medium", "info"]
FINDING_TYPES = ["present_risky", "absent", "ambiguous", "none"]
MATERIALITIES = ["material", "immaterial"]
CLASSIFICATION_STATUSES = ["ok", "low_confidence", "failed"]
CITATION_BASES = ["statutory", "doctrinal"]
JOB_STATES = ["queued", "running", "done", "failed"]
CHANGE_KINDS = ["added", "removed", "modified"]
SOURCE_FORMATS = ["docx", "pdf_text", "pdf_image", "image"]
UPLOAD_EXTENSIONS = ["docx", "pdf"]
EXTRACTOR_EXTENSIONS = ["docx", "pdf", "jpg", "jpeg", "png", "webp", "bmp"]

# --- fixed values: the 18 risk domains, in evaluation order ------------------
DOMAINS = [
    "scope_deliverables",
    "exclusivity",
    "ip_ownership",
    "moral_rights",
    "usage_rights",
    "payment_terms",
    "term_termination",
    "morality_clause",
    "content_approval",
    "confidentiality",
    "personal_data_likeness",
    "liability_indemnity",
    "non_compete",
    "dispute_forum",
    "governing_language",
    "agency_commission",
    "disclosure_compliance",
    "execution_validity",
]
ALWAYS_EVALUATED = ["governing_language", "execution_validity"]

# --- fixed values: limits -----------------------------------------------------
MAX_FILE_BYTES = 20 * 1024 * 1024
MIN_CHARS = 100
MIN_COVERAGE_RATIO = 0.5
MIN_CHARS_PER_PAGE = 40
MIN_CHARS_PER_KB = 0.5
MAX_CONTEXT_CHARS = 6000
MAX_SUMMARY_CHARS = 4000
MAX_COMMENTS = 20
DIFF_BATCH = 5
MAX_ATTEMPTS = 2
FINDING_LENGTHS = {"summary": 1000, "rationale": 4000, "negotiation_ask": 2000}
EDIT_LENGTHS = {"original_text": 4000, "revised_text": 4000, "comment": 1000}
DEFAULT_QUOTA = 8
RETENTION_DAYS = 30
LOCKOUT_WINDOW_SECONDS = 15 * 60
LOCKOUT_PER_IDENTIFIER = 5
LOCKOUT_PER_ADDRESS = 15

# --- fixed values: blanks removed by a strip ------------------------------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: clause markers (anchored at a line start) -----------------
# the possessive group matches the same text and needs no stack for long numbers
HEADING = r"^(PASAL|Pasal|ARTICLE|Article)\s+(\d+[A-Z]?)\b"
DOTTED = r"^(\d+\.\d+(?:\.\d+)*+)\s+"
NUMBERED = r"^(\d+)\.\s+"
PARENTHESISED = r"^\((\d+)\)\s+"
LETTERED = r"^\(([a-z])\)\s+"

# --- fixed values: personal-data patterns, most specific first ---------------
PII_PATTERNS = [
    ("NIK", r"(?<!\d)\d{16}(?!\d)"),
    ("NPWP", r"\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?<!\d)(\+62|62|0)[0-9](?:[0-9\s\-]{4,11}[0-9])?(?!\d)"),
    ("BANK", r"(?<!\d)\d{10,15}(?!\d)"),
    (
        "ADDR",
        r"(?im)\b(jl\.|jalan|gg\.|gang|rt\s*\.?\s*\d+|rw\s*\.?\s*\d+)"
        r"[^\n]{0,120}(?=\n|,|\.|$)",
    ),
]
# a phone must carry the optional digit groups (option, see operators.redact)
STRICT_PHONE = r"(?<!\d)(\+62|62|0)[0-9](?:[0-9\s\-]{4,11}[0-9])(?!\d)"

# --- fixed values: where an answer holds its JSON ---------------------------------
JSON_FENCE = r"```(?:json)?\s*([\s\S]+?)\s*```"
JSON_BRACES = r"\{[\s\S]+\}"

# --- fixed values: labels printed into requests and notes -------------------------
CLAUSE_LABEL = "Klausul"
SUBITEM_LABEL = "Ayat"
PARAGRAPH_LABEL = "Paragraf"
NO_MATCHING_CLAUSE = "(Tidak ada klausul yang cocok dengan domain ini)"
NO_CLAUSE_ALWAYS = (
    "Tidak ada klausul yang secara eksplisit membahas domain ini dalam kontrak. "
    "Evaluasi apakah ketidakhadiran klausul ini sendiri merupakan temuan."
)
NO_CLAUSES_SUMMARY = "Dokumen tidak memiliki klausul yang dapat diekstrak."
NO_SUMMARY = (
    "Ringkasan dokumen tidak tersedia untuk analisis ini — "
    "gunakan klausul di bawah sebagai satu-satunya konteks."
)
SUMMARY_HEADER = "Ringkasan Dokumen:"
CLAUSES_HEADER = "Klausul-Klausul yang Relevan dengan Domain"
COMMENTS_HEADER = "Komentar yang Ditambahkan oleh Pihak Lain dalam Dokumen:"
TASK_LINE = "Analisis kontrak ini untuk domain:"
ANONYMOUS = "Tanpa nama"
ANCHOR_LABEL = "terkait teks"
CHANGE_LABELS = {
    "added": "Klausul baru ditambahkan",
    "removed": "Klausul dihapus",
    "modified": "Klausul diubah",
}
BEFORE_LABEL = "Teks sebelumnya:"
AFTER_LABEL = "Teks baru:"
EMPTY_NOTES = {
    "docx": "Dokumen DOCX tidak mengandung teks yang dapat dibaca.",
    "pdf_image": "OCR tidak berhasil mengekstrak teks dari PDF.",
    "image": "OCR tidak menghasilkan teks yang memadai dari gambar.",
}
PARTIAL_NOTES = {  # format templates
    "docx": (
        "Ekstraksi DOCX tampak tidak lengkap (%d dari perkiraan %d karakter dalam dokumen). "
        "Dokumen ini memerlukan tinjauan manual."
    ),
    "pdf_text": (
        "Ekstraksi PDF tampak tidak lengkap (%d karakter dari %d halaman). "
        "Dokumen ini memerlukan tinjauan manual."
    ),
    "ocr": (
        "OCR menghasilkan teks yang tampak tidak lengkap (%d karakter dari %d halaman). "
        "Dokumen ini memerlukan tinjauan manual."
    ),
}
OCR_WARNINGS = {
    "pdf_image": (
        "Dokumen ini adalah PDF berbasis gambar. "
        "Akurasi ekstraksi teks dapat bervariasi — verifikasi klausul penting secara manual."
    ),
    "image": (
        "Dokumen diunggah sebagai gambar. "
        "Akurasi ekstraksi teks dapat bervariasi — verifikasi klausul penting secara manual."
    ),
}
MISSING_ANSWER = "Respons model tidak lengkap untuk entri ini"
MISSING_CLASS = "Model tidak memberikan klasifikasi"
OUT_OF_VOCABULARY = "Jawaban model di luar vokabulari"
UNPARSABLE_BATCH = "Respons model tidak dapat diurai"
NO_REASON = "Tidak ada alasan diberikan"

# --- fixed values: job messages (format templates) -------------------------------
PARTIAL_HEADER = "Analisis selesai: %d/%d domain berhasil, %d domain gagal:\n"
MAJORITY_FAILED = "Analisis gagal: %d dari %d pemeriksaan tidak dapat diselesaikan. "
QUOTA_RETURNED = "Kuota analisis Anda telah dikembalikan. "
RETRY_HINT = (
    "Silakan coba lagi — pemeriksaan yang sudah berhasil tidak akan diulang. "
    "Jika masalah berlanjut, unggah ulang dokumen dan pastikan formatnya .docx dan terstruktur."
)
