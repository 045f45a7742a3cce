"""The markers of the letters. They have to be these for right results."""

# Java needs (?iUd) to treat case, classes and line ends of Vietnamese text as intended. Repetitions are of one character class each and
# give nothing back (*+) where what follows can't begin with it: a repeated group takes Java's stack, and neighbours that give back take cubic time.
FLAGS = "(?iUd)"

S1_PHRASE = "nội dung kiến nghị"
S1_NOT = FLAGS + r"nội dung kiến nghị[^a-zà-ỹ]*?(?:được|đang|đã|thuộc)\b"
S2 = FLAGS + r"kết quả nghiên cứu, giải quyết và trả lời kiến nghị"
GROUP = FLAGS + r"^\s*+[#*\-_ ]*+\s*+(?:[IVXL]+\b[#*_ .]*(?:Kiến nghị số|Đối với kiến nghị số)|\d+\.\s*(?:Kiến nghị số|Đối với kiến nghị số))"
LETTER_END = FLAGS + r"^[#*_\s]*+(?:Nơi nhận|BỘ TRƯỞNG|Lưu:|<!-- Start of picture)"
RESPONSIBILITY = FLAGS + r"^[#*_>\s]*+\d*+\.?+\s*+Trách nhiệm tiếp tục theo dõi, thông tin kết quả"
CLOSING = FLAGS + r"trân trọng\s*(?:kính\s*)?g\s*ửi\s+(?:Đoàn\s+đại biểu Quốc hội|Ủy ban Dân nguyện)"
ITEM = FLAGS + r"^\s*+[_\*#\- ]*+(?:\(\d+\)|\d+\.\d+\.|\d+\.)?+\s*+[_\*]*+Kiến nghị số\s*+(\d++)\s*+[:：]"
ANSWER_HEAD = FLAGS + r"^[#*_>\s]*+\d++\.\d++\.?+\s*+(?:Về|Đối với)\s*+kiến nghị số\s*([^:\n]{1,80})"
FOOTNOTE_MARK = r"<sup>\s*(?:\[\d+\]|\d{1,2})\s*</sup>"
SUPERSCRIPT = FLAGS + FOOTNOTE_MARK + r"|[²³¹⁰-⁹]"
#: In front only what stands in the line itself; behind the slash code characters and white space, up to one before V/v or a line's end.
LETTER_NUMBER = "(?iUdm)" + r"^[#*_>\s&&[^\n]]*+Số\*{0,2}+\s*+[:\-]?+\s*+\*{0,2}+\s*+(\d*+\s*+/[A-Za-z0-9Đđ\-](?:[A-Za-z0-9Đđ\-\s]*[A-Za-z0-9Đđ\-])?)\*{0,2}(?=\s*V/v|\s*$)"
ISSUE_DATE = FLAGS + r"_?Hà Nội,[\s_]*ngày[\s_]*(\d{1,2})[\s_]*tháng[\s_]*(?:(\d{1,2})[\s_]*)?năm[\s_]*(\d{4})"
#: A name begins behind all white space; white space alone counts as an empty one.
SIGNER = FLAGS + r"(?:\*\*)?BỘ\s+TRƯỞNG(?:\s++(?:([^\s*<][^\n\r*<]*?)|(?<=\s[^\S\n\r])))?(?:\*\*)?(?=\s*(?:\n|<|Nơi nhận|$))"
LEGAL_WORDS = FLAGS + r"\b(?:đã|quy định|ban hành|sửa đổi|bãi bỏ|thông tư|nghị định|quyết định)\b"
HEADING = r"^#{1,6}\s"
UNIT_CUE = r"(?U)(?<=[.;])\s*(?=(?:Đề nghị|Kiến nghị|Đồng thời[, ]+đề nghị|Ngoài ra,?\s*đề nghị|Bên cạnh đó,?\s*đề nghị)\b)"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
DELEGATION = "Đoàn đại biểu Quốc hội"
DELEGATION_OF = ("Đoàn đại biểu Quốc hội tỉnh", "Đoàn đại biểu Quốc hội thành phố")
DELEGATION_KEYS = ("doan dai bieu quoc hoi ", "doan dbqh ")
UNIT_PREFIX = "^(?:tinh|thanh pho) "
MINISTER = "Bộ trưởng"
OCR_MISREAD = ("ḗḖṓṒ", "ếẾốỐ")
MINISTRIES = (
    "Bộ Nông nghiệp và Môi trường", "Bộ Tài nguyên và Môi trường", "Bộ Tài chính", "Bộ Công Thương", "Bộ Y tế", "Bộ Xây dựng",
    "Bộ Giao thông vận tải", "Bộ Giáo dục và Đào tạo", "Bộ Kế hoạch và Đầu tư", "Bộ Văn hóa, Thể thao và Du lịch",
    "Bộ Lao động - Thương binh và Xã hội", "Bộ Khoa học và Công nghệ", "Bộ Thông tin và Truyền thông", "Bộ Tư pháp",
    "Bộ Nội vụ", "Bộ Quốc phòng", "Bộ Công an", "Bộ Ngoại giao",
)
THRESHOLD = 0.5
HEADER_LINES, TAIL_LINES, SIGNER_CHARS = 50, 40, 60
RETRIED = (429, 500, 502, 503, 504)
