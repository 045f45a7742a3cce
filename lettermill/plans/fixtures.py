"""Synthetic letters, dictionaries and petitions of this project: a few by hand, and one for each customer."""

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = [
    (1, "FILE_001", "**Số:** 4512 /BABC-KHTC\nHà Nội, ngày 5 tháng 8 năm 2026\nKính gửi: Đoàn đại biểu Quốc hội tỉnh Alpha\n## 1. Nội dung kiến nghị của cử tri\n“Đề nghị hỗ trợ nông dân trồng lúa.”\n## 2. Kết quả nghiên cứu, giải quyết và trả lời kiến nghị\nBộ đã ban hành chính sách hỗ\n*<sup>1</sup> Khoản 1 Điều 2*\n\ntrợ nông dân<sup>1</sup> trong **năm 2026**.\n> Chú thích cuối trang\nNơi nhận:\n**BỘ TRƯỞNG Lê Thị Mẫu**"),
    (2, "FILE_002", "## Số:3366 /BABC-VPĐP\n_Hà Nội, ngày_ 17 _tháng       năm 2026_ 7\n- Đoàn đại biểu Quốc hội thành phố Beta Gamma;\nI. Kiến nghị số 50\n**1. Nội dung kiến nghị**\nXây cầu mới qua sông.\n**2. KẾT QUẢ nghiên cứu, giải quyết và trả lời kiến nghị**\nĐang lập dự án.\nNội dung kiến nghị đã được ghi nhận.\nII. Kiến nghị số 51\n**1. Nội dung kiến nghị**\nSửa đường liên xã.\n**2. Kết quả nghiên cứu, giải quyết và trả lời kiến nghị**\nĐã bố trí vốn.\n## 3. Trách nhiệm tiếp tục theo dõi, thông tin kết quả\nBộ tiếp tục theo dõi.\nNơi nhận: BỘ TRƯỞNG<br><!-- x -->"),
    (3, "FILE_003", "Số: /BYT-VP\n## 1. Nội dung kiến nghị\n(1) Kiến nghị số 04: Tăng bác sĩ cho xã.\n(2) Kiến nghị số 13: Mua máy X quang.\n(3) Kiến nghị số 99: Giảm viện phí.\n## 2. Kết quả nghiên cứu, giải quyết và trả lời kiến nghị\nMở đầu chung.\n2.1. Về kiến nghị số 04 và số 13\nSẽ tăng biên chế.\n2.2. Đối với kiến nghị số 20\nNội dung khác.\nBộ Y tế trân trọng gửi Đoàn đại biểu Quốc hội tỉnh Alpha để thông tin."),
    (4, "FILE_004", "Hà Nội, ngày 01 tháng 12 năm 2026\nCử tri phản ánh giá điện cao. Đề nghị giảm giá điện; Kiến nghị minh bạch hóa đơn.\n\n## (1) Về giá điện\nGiá điện được điều chỉnh theo quy định."),
]
UNITS = {"Tỉnh Alpha": 1, "Thành phố Beta Gamma": 2, "Tỉnh Beta": 3}
PETITIONS = [(101, 1, "Đề nghị hỗ trợ nông dân trồng lúa"), (102, 2, "Xây cầu mới"), (103, 1, "Sửa trường học"), (104, 3, "Kiến nghị số 13: mua máy X quang")]
#: With one that only a letter without a known layout answers.
JOB_PETITIONS = [*PETITIONS, (105, 1, "Cử tri phản ánh giá điện cao, đề nghị giảm giá điện; kiến nghị minh bạch hóa đơn.")]


def model(label: str, prompt: str, hint: str | None) -> str:
    """Stands for a language model: groups the units of letter 4, the petitions in one group too many."""
    return 'Here: [["U2","U3"],["U4","U77"]]' if label == "KN" else '```json\n[["U6","U5"]]\n```'


#: Twenty-five provinces, one for each nation.
PROVINCES = {f"Tỉnh Vùng {chr(65 + i)}": i + 1 for i in range(25)}

_HEAD = [
    "{ministry}**Số:** {k} /BXD-QLN", "Hà Nội, ngày {day} tháng {month}năm 2025", "{greeting}",
]
_ANSWER = "Kết quả nghiên cứu, giải quyết và trả lời kiến nghị"
#: By custkey % 4: layouts f1, f2, f3 and none.
_BODIES = [
    ["## 1. Nội dung kiến nghị của cử tri", "“Việc {k}a {k}b {k}c {k}d {k}e tại chỗ.”", f"## 2. {_ANSWER}", "Bộ đã xem xét việc {k}", "*<sup>1</sup> Khoản 3 Điều 2*", "", "và trả lời<sup>1</sup> như sau.", "Nơi nhận:", "**BỘ TRƯỞNG Lê Thị Mẫu**"],
    ["I. Kiến nghị số {k}", "**1. Nội dung kiến nghị**", "Xây cầu {k}.", f"**2. {_ANSWER}**", "Đang lập dự án {k}.", "II. Kiến nghị số {k}", "**1. Nội dung kiến nghị**", "Sửa đường {k}.", f"**2. {_ANSWER}**", "Đã bố trí vốn cho {segment}.", "## 3. Trách nhiệm tiếp tục theo dõi, thông tin kết quả", "Bộ tiếp tục theo dõi.", "Nơi nhận: BỘ TRƯỞNG"],
    ["## 1. Nội dung kiến nghị", "(1) Kiến nghị số {k}: Tăng bác sĩ.", "(2) Kiến nghị số {next}: Mua máy.", f"## 2. {_ANSWER}", "Mở đầu {k}.", "2.1. Về kiến nghị số {k}", "Sẽ tăng biên chế.", "2.2. Đối với kiến nghị số {next}", "Sẽ mua máy {segment}.", "Bộ trân trọng gửi Đoàn đại biểu Quốc hội để thông tin."],
    ["Cử tri phản ánh việc {k}. Đề nghị giảm giá; Kiến nghị minh bạch {segment}.", "", "## (1) Về {segment}", "Giá {k} được điều chỉnh."],
]


def _filled(text: str, values: dict[str, Column]) -> Column:
    return F.concat(*[values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p])


def customer_letters(customers: DataFrame, header: bool = True) -> DataFrame:
    """doc_id, file_id and text of a letter for each customer (c_custkey, c_nationkey, c_mktsegment)."""
    k = F.col("c_custkey")
    values = {
        "k": k.cast("string"), "next": (k + 1).cast("string"), "segment": F.lower("c_mktsegment"), "day": (k % 28 + 1).cast("string"),
        "month": F.when(k % 7 == 0, "").otherwise(F.concat((k % 12 + 1).cast("string"), F.lit(" "))),
        "ministry": F.when(k % 2 == 0, "# Bộ Xây dựng\n").otherwise(""),
        "greeting": F.when(k % 11 == 0, "Kính gửi: Quý vị").otherwise(F.concat(F.lit("Kính gửi: Đoàn đại biểu Quốc hội tỉnh Vùng "), F.char((F.col("c_nationkey") + 65).cast("long")))),
    }
    shapes = [_filled("\n".join([*(_HEAD if header else []), *body]), values) for body in _BODIES]
    text = F.when(k % 4 == 0, shapes[0]).when(k % 4 == 1, shapes[1]).when(k % 4 == 2, shapes[2]).otherwise(shapes[3])
    return customers.select(k.cast("long").alias("doc_id"), F.format_string("FILE_%06d", k).alias("file_id"), text.alias("text"))


def customer_petitions(customers: DataFrame) -> DataFrame:
    """petition_id, donvi_id and noi_dung: what every fourth customer's letter answers."""
    k = F.col("c_custkey")
    return customers.select(k.cast("long").alias("petition_id"), (F.col("c_nationkey") + 1).cast("long").alias("donvi_id"), _filled("Việc {k}a {k}b {k}c {k}d {k}e tại", {"k": k.cast("string")}).alias("noi_dung"))


def customer_model(label: str, prompt: str, hint: str | None) -> str:
    """Stands for a language model that groups the units of a letter without a layout."""
    return 'Here: [["U1","U2"],["U3","U77"]]' if label == "KN" else '```json\n[["U5","U4"]]\n```'


def page_ocr(content: bytes) -> tuple[int, str]:
    """Stands for OCR to JSON: refuses every seventh page."""
    text = bytes(content).decode()
    return (400, "") if int(text.split()[0]) % 7 == 0 else (200, json.dumps({"content": f"read\\n{text}", "pages": [int(text.split()[0])]}))


async def page_render(canonical: bytes) -> tuple[int, str]:
    """Stands for the service that renders JSON as markdown, blank for every third page; asked without a thread of its own."""
    page = json.loads(bytes(canonical))["pages"][0]
    return 200, json.dumps({"content": " " if page % 3 == 0 else f"# {page}\nread"})
