"""Fixed values of the rule sets: word lists, patterns and sizes that results depend on. Data only, no logic.

`VIETNAMESE` is the default preset (student handbooks and regulations). Every operator takes its rules as an argument,
so another language or domain is another instance.
"""
from __future__ import annotations

from dataclasses import dataclass, field

#: Unicode white space as one explicit regex class body, the same in every regex dialect used here.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same without the line feed.
WS_INLINE = r"\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Control characters that cleaning drops; tab, line feed and carriage return stay.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Letters and digits by Unicode category, and the underscore: what counts as part of a word.
WORD_CLASS = r"\p{L}\p{N}_"

# The letters that may end and begin a line that was broken in mid sentence.
LOWER_VI = "a-zàáạảãăắằặẳẵâấầậẩẫđèéẹẻẽêếềệểễìíịỉĩòóọỏõôốồộổỗơớờợởỡùúụủũưứừựửữỳýỵỷỹ"

# Corrections of recognised text, applied in this order.
OCR_PAGE_FIXES = (
    ("Ðiều", "Điều"), ("Ðại", "Đại"), ("Ðào", "Đào"), ("Ðánh", "Đánh"), ("Ðể", "Để"), ("Ðược", "Được"),
    ("Ðối", "Đối"), ("Ðơn", "Đơn"), ("Ðình", "Đình"), ("Ðiểm", "Điểm"), ("Ðăng", "Đăng"), ("Ðồng", "Đồng"),
    ("lI", "II"), ("Il", "II"), ("Ill", "III"),
)
OCR_TEXT_FIXES = (
    ("Ðiều", "Điều"), ("Ðại", "Đại"), ("Ðào", "Đào"), ("Ðánh", "Đánh"),
    ("Ðể", "Để"), ("Ðược", "Được"), ("Ðối", "Đối"), ("Ðơn", "Đơn"),
)
STAMPS = ("[Con dấu]", "[Chữ ký]")
PAGE_WORD = "Trang"

# Abbreviations and what they stand for, in order.
ABBREVIATIONS = (
    ("SV", "sinh viên"), ("ĐH", "đại học"), ("P.ĐH", "Phòng đại học"),
    ("HK", "học kỳ"), ("TC", "tín chỉ"), ("GPA", "điểm trung bình tích lũy"),
)

# Section headers at the start of a line; the first word of a chapter header; the name of what precedes.
SECTION_HEADER = r"(?:Chương[" + WS + r"]+[IVXLCDM\p{Nd}]+|Điều[" + WS + r"]+\p{Nd}+|Mục[" + WS + r"]+\p{Nd}+|Phần[" + WS + r"]+[IVXLCDM\p{Nd}]+)"
CHAPTER_WORD = "Chương"
PREAMBLE = "Phần mở đầu"

# Tags by keyword.
AUDIENCE_TAGS = (
    ("sinh viên", ("sinh viên", "sv", "người học", "học viên")),
    ("giảng viên", ("giảng viên", "gv", "người dạy", "giáo viên")),
    ("cán bộ", ("cán bộ", "nhân viên", "viên chức")),
)
AUDIENCE_DEFAULT = "tất cả"
KIND_TAGS = (
    ("quy định", ("quy định", "điều", "khoản")),
    ("hướng dẫn", ("hướng dẫn", "thủ tục", "quy trình", "trình tự")),
    ("quy chế", ("quy chế",)),
    ("thông báo", ("thông báo", "thông tin")),
)
KIND_DEFAULT = "quy định"
IMPORTANT = ("bắt buộc", "cấm", "kỷ luật", "buộc thôi học", "học bổng")
IMPORTANCE = ("cao", "trung bình")

# Topics by pattern, tested on lower-case text.
TOPICS = (
    ("tot_nghiep", r"tốt nghiệp|ra trường|nhận bằng|xét tốt nghiệp|bằng tốt nghiệp"),
    ("hoc_phi", r"học phí|đóng tiền|miễn giảm|học bổng|trả tiền|công nợ"),
    ("ky_luat", r"khen thưởng|kỷ luật|vi phạm|cảnh cáo|đình chỉ|buộc thôi|đuổi học"),
    ("dao_tao", r"đào tạo|tín chỉ|học kỳ|đăng ký|môn học|điểm số|GPA|CPA|xét học vụ"),
    ("ren_luyen", r"rèn luyện|điểm rèn luyện|hạnh kiểm|đánh giá rèn luyện"),
    ("thuc_tap", r"thực tập|khóa luận|đồ án|luận văn|tốt nghiệp"),
    ("ky_tuc_xa", r"ký túc|nội trú|phòng ở|chỗ ở|khu nội trú"),
    ("thu_vien", r"thư viện|mượn sách|tài liệu|phòng đọc"),
)
# Words of a question that name its audience, the first that occurs decides.
AUDIENCE_OF_QUERY = (
    ("sinh viên", "sinh viên"), ("sv", "sinh viên"), ("giảng viên", "giảng viên"),
    ("gv", "giảng viên"), ("cán bộ", "cán bộ"), ("nhân viên", "cán bộ"),
)

# Informal phrases of questions and their formal forms, in order.
SYNONYMS = (
    ("đuổi học", "buộc thôi học"), ("bị đuổi", "bị buộc thôi học"), ("nghỉ học", "bảo lưu kết quả học tập"),
    ("bỏ học", "thôi học tự nguyện"), ("thi lại", "thi kết thúc học phần lần hai"), ("học lại", "đăng ký học lại học phần"),
    ("trượt", "không đạt"), ("rớt", "không đạt"), ("rớt môn", "không đạt học phần"),
    ("điểm liệt", "điểm dưới mức tối thiểu"), ("nợ môn", "chưa hoàn thành học phần"), ("GPA", "điểm trung bình tích lũy"),
    ("ra trường", "xét tốt nghiệp"), ("deadline", "thời hạn quy định"), ("chuyển trường", "chuyển cơ sở đào tạo"),
    ("bị cảnh cáo", "cảnh báo học vụ"), ("xin phép", "đơn đề nghị"), ("đóng tiền", "nộp học phí"),
    ("hoãn thi", "tạm hoãn thi kết thúc học phần"), ("gap year", "bảo lưu kết quả học tập"), ("chuyển ngành", "chuyển ngành đào tạo"),
    ("điểm danh", "theo dõi chuyên cần"), ("vắng thi", "vắng mặt trong kỳ thi"), ("phúc khảo", "phúc tra bài thi"),
)
ARTICLE_REF = r"[Đđ]iều[" + WS + r"]+(\p{Nd}+)"
CLAUSE_REF = r"[Kk]hoản[" + WS + r"]+(\p{Nd}+)"
CROSS_REF = r"(?iu)quy định tại|theo quy định|trừ trường hợp"

# Question templates and what triggers them.
QA_UNITS = (
    (r"\p{Nd}+[" + WS + r"]*tín chỉ", "số tín chỉ"), (r"\p{Nd}+[" + WS + r"]*học kỳ", "số học kỳ"),
    (r"\p{Nd}+[" + WS + r"]*ngày", "số ngày"), (r"\p{Nd}+[" + WS + r"]*tháng", "số tháng"),
    (r"\p{Nd}+(?:[.,]\p{Nd}+)?[" + WS + r"]*điểm", "mức điểm"), (r"\p{Nd}+[" + WS + r"]*%", "tỷ lệ"),
    (r"\p{Nd}+[" + WS + r"]*năm", "thời gian"), (r"\p{Nd}+[" + WS + r"]*lần", "số lần"),
)
QA_CONDITIONS = (
    r"[Nn]ếu[" + WS + r"]+[^\n]{15,}?(?:thì|sẽ|phải)[^\n]{10,}?[.;]",
    r"[Tt]rường hợp[" + WS + r"]+[^\n]{15,}?[.;]",
    r"[Kk]hông được[" + WS + r"]+[^\n]{10,}?[.;]",
)
QA_PROCEDURES = ("thủ tục", "quy trình", "hồ sơ", "trình tự", "bao gồm", "cần có")
QA_PURPOSES = ("nhằm", "mục đích", "với mục tiêu", "để đảm bảo")
QA_TYPES = ("factual", "conditional", "procedural", "reasoning")
QA_TEXTS = {
    "prefix_section": "Theo {section}, ",
    "prefix": "Theo quy chế, ",
    "main_section": "{section} quy định những nội dung gì?",
    "main_topic": 'Quy chế quy định gì về: "{topic}"?',
    "unit": "{unit} được quy định như thế nào?",
    "forbidden_mark": "không được",
    "forbidden": "sinh viên không được làm gì?",
    "condition": "Điều gì xảy ra trong trường hợp được nêu tại {where}?",
    "condition_where": "quy chế",
    "procedure": "{word} được quy định thế nào?",
    "purpose": "Mục đích của {where} là gì?",
    "purpose_where": "quy định này",
    "summary": "Hãy tóm tắt nội dung chính của {where}.",
    "summary_where": "đoạn quy chế này",
}

# Texts of answers and prompts.
ANSWER_TEXTS = {
    "rejected": "Không tìm thấy thông tin liên quan trong quy chế hiện có. Vui lòng liên hệ phòng Công tác Sinh viên để được hỗ trợ.",
    "caution": "[LƯU Ý: Thông tin dưới đây có thể không hoàn toàn chính xác cho câu hỏi này. Hãy trả lời thận trọng và ghi rõ nếu không chắc chắn.]\n\n",
    "context": "Ngữ cảnh từ quy chế{institution}:\n---\n{context}\n---\n\nCâu hỏi: {query}\nHãy trả lời dựa trên ngữ cảnh trên.",
    "meta": "[{meta}]\n\nCâu hỏi: {query}",
    "audience": "Đối tượng: ",
    "kind": "Loại: ",
    "importance": "Mức quan trọng: ",
    "grounding": "Ngữ cảnh quy chế:\n",
    "question": "Câu hỏi: ",
    "keywords": "Từ khóa: ",
    "no_hits": "Không tìm thấy chunks liên quan",
    "sources": "\n\n📚 **Nguồn:** ",
    "sections": "\n📋 **Phần:** ",
    "failed_page": "[Không trích xuất được text trang {page}]",
}
MODES = {"rag": "RAG-Enhanced+HyDE+CRAG", "rejected": "RAG-CRAG-Rejected", "plain": "No-RAG"}
CONFIGS = (("A", False, False), ("B", True, False), ("C", False, True), ("D", True, True))

# The sheet that people fill in, and the comparison table.
HUMAN_EVAL_COLUMNS = ("STT", "Câu hỏi", "Gold Answer")
HUMAN_EVAL_CRITERIA = ("Accuracy", "Completeness", "Naturalness")
COMPARISON_COLUMNS = ("Config", "Label", "BLEU", "ROUGE-L", "BERTScore_F1", "Recall@5", "Time(s)", "Num_Samples")


@dataclass(frozen=True)
class Sizes:
    """Lengths in characters and counts."""

    chunk: int = 768
    least_chunk: int = 50
    tiny: int = 80
    oversized: int = 3000
    answer_sentence: int = 25
    context_sentence: int = 15
    verbatim: int = 1500
    sentences: int = 10
    grounding: int = 1200
    top_k: int = 20
    rerank_k: int = 5
    least_results: int = 20
    rrf: int = 60
    extra: int = 2


@dataclass(frozen=True)
class RuleSet:
    """One domain's rules."""

    fixes: tuple[tuple[str, str], ...] = OCR_TEXT_FIXES
    stamps: tuple[str, ...] = STAMPS
    page_word: str = PAGE_WORD
    lower: str = LOWER_VI
    abbreviations: tuple[tuple[str, str], ...] = ABBREVIATIONS
    header: str = SECTION_HEADER
    chapter_word: str = CHAPTER_WORD
    preamble: str = PREAMBLE
    audience: tuple[tuple[str, tuple[str, ...]], ...] = AUDIENCE_TAGS
    audience_default: str = AUDIENCE_DEFAULT
    kinds: tuple[tuple[str, tuple[str, ...]], ...] = KIND_TAGS
    kind_default: str = KIND_DEFAULT
    important: tuple[str, ...] = IMPORTANT
    importance: tuple[str, str] = IMPORTANCE
    topics: tuple[tuple[str, str], ...] = TOPICS
    audience_of_query: tuple[tuple[str, str], ...] = AUDIENCE_OF_QUERY
    synonyms: tuple[tuple[str, str], ...] = SYNONYMS
    qa_units: tuple[tuple[str, str], ...] = QA_UNITS
    qa_conditions: tuple[str, ...] = QA_CONDITIONS
    qa_procedures: tuple[str, ...] = QA_PROCEDURES
    qa_purposes: tuple[str, ...] = QA_PURPOSES
    sizes: Sizes = field(default_factory=Sizes)


VIETNAMESE = RuleSet()
