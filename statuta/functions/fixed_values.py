"""Word lists, phrases, patterns and constants of the Vietnamese legal domain.

Everything in this module must keep exactly these values for results to stay
comparable; nothing here is logic.
"""

# ---- tokens -----------------------------------------------------------------
# Fixed value: letters (with Vietnamese diacritics) and digits that form a token of a lower-case text.
VI_TOKEN_PATTERN = "[a-záàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ0-9]+"
# The same class in the order in which Java tests it fastest: a plain list is one nested test per letter, and all of them run for every character.
VI_TOKEN_RUNS = "[a-z0-9[à-ỹ&&[" + VI_TOKEN_PATTERN.removeprefix("[a-z").removesuffix("0-9]+") + "]]]+"

# ---- keywords ---------------------------------------------------------------
# Words that carry no meaning for keyword matching.
STOPWORDS = [
    "của", "và", "là", "được", "có", "trong", "cho", "với", "theo",
    "các", "những", "này", "đó", "để", "về", "từ", "tại", "khi",
    "nào", "gì", "như", "thế", "sao", "ai", "đâu", "bao",
    "không", "hay", "hoặc", "mà", "thì", "cũng", "đã", "sẽ",
    "rất", "lại", "nếu", "vì", "do", "bởi", "một", "người",
    "trên", "dưới", "sau", "trước", "đến", "bị", "phải",
    "còn", "nên", "đều", "chỉ", "ra", "vào", "lên",
]
# The shorter stop list used by the fallback coverage check.
FALLBACK_STOPWORDS = [
    "của", "và", "là", "được", "có", "trong", "cho", "với", "theo",
    "các", "những", "này", "đó", "để", "về", "từ", "tại", "khi",
    "nào", "gì", "như", "thế", "sao", "ai", "đâu", "bao", "thì",
]
# Legal compounds, three and more words first.
LEGAL_COMPOUNDS = [
    "ủy ban nhân dân", "hội đồng nhân dân", "bảo hiểm xã hội",
    "bảo hiểm y tế", "quyền sử dụng đất", "giấy chứng nhận",
    "cơ quan nhà nước", "trách nhiệm hình sự", "trách nhiệm dân sự",
    "thi hành án", "cấp giấy phép", "đăng ký kinh doanh",
    "an ninh quốc gia", "an toàn giao thông", "bảo vệ môi trường",
    "giải quyết tranh chấp", "quyền sở hữu", "sở hữu trí tuệ",
    "thẩm quyền", "xử phạt", "vi phạm", "nghị định", "thông tư",
    "quyết định", "văn bản", "pháp luật", "quy định", "điều kiện",
    "thủ tục", "hồ sơ", "đăng ký", "cấp phép", "giấy phép",
    "lệ phí", "thuế thu", "thu nhập", "doanh nghiệp", "tổ chức",
    "cá nhân", "hộ gia đình", "thời hạn", "thời hiệu",
    "hình sự", "dân sự", "hành chính", "lao động", "bồi thường",
    "khiếu nại", "tố cáo", "xử lý", "trách nhiệm",
    "chế tài", "biện pháp", "quy hoạch", "xây dựng",
    "đất đai", "nhà ở", "giao thông", "môi trường",
    "sở hữu", "chuyển nhượng", "thừa kế", "hợp đồng",
    "bảo hiểm", "ngân sách", "tài chính", "kinh doanh",
    "đầu tư", "xuất khẩu", "nhập khẩu", "hải quan",
]

# ---- query classes ----------------------------------------------------------
# Query classes and the phrases that mark them, in output order.
QUERY_TYPES = [
    ("định nghĩa", ["định nghĩa", "là gì", "được hiểu", "khái niệm"]),
    ("điều kiện", ["điều kiện", "yêu cầu", "tiêu chuẩn", "đáp ứng"]),
    ("thủ tục", ["thủ tục", "trình tự", "hồ sơ", "quy trình"]),
    ("thẩm quyền", ["thẩm quyền", "có quyền", "chịu trách nhiệm", "thuộc"]),
    ("xử phạt", ["xử phạt", "phạt tiền", "vi phạm", "chế tài"]),
    ("phí", ["phí", "lệ phí", "chi phí", "thu phí"]),
    ("thời hạn", ["thời hạn", "trong vòng", "ngày", "tháng", "năm"]),
]

# Patterns of unclear questions and the question asked back.
CLARIFY_PATTERNS = [
    (r"(?U)\bnày\b(?! (?:là|quy|nghị))", "Bạn đang hỏi về văn bản nào cụ thể?"),
    (r"(?U)\bđó\b", "Bạn có thể cho biết cụ thể hơn về đối tượng/văn bản?"),
    (r"^(?:ai|gì|sao|nào)\??$", "Câu hỏi hơi ngắn, bạn có thể mô tả chi tiết hơn?"),
]
# Terms that need context in questions of fewer than ten words.
CLARIFY_TRIGGERS = [
    ("lĩnh vực", "Bạn đang hỏi về lĩnh vực quản lý nào?"),
    ("địa phương", "Đây là địa phương/tỉnh/thành phố nào?"),
    ("đối tượng", "Đối tượng áp dụng cụ thể là ai?"),
]

# Kinds of missing information: (kind, triggers, question, pattern of a concrete value).
MISSING_INFO = [
    (
        "location",
        ["địa phương", "tỉnh", "huyện", "xã", "thành phố", "quận", "khu vực"],
        "Bạn đang hỏi về địa phương/khu vực nào cụ thể?",
        r"(?iU)\b(hà nội|hồ chí minh|đà nẵng|hải phòng|cần thơ|tỉnh \w+|huyện \w+|quận \w+)\b",
    ),
    (
        "time",
        ["thời điểm", "năm", "khi nào", "từ khi", "đến khi", "hiệu lực"],
        "Bạn muốn biết thông tin áp dụng cho thời điểm nào?",
        r"(?iU)\b(năm \d{4}|ngày \d{1,2}|\d{1,2}/\d{1,2}/\d{4}|từ năm|đến năm)\b",
    ),
    (
        "subject",
        ["đối tượng", "ai", "người nào", "tổ chức", "doanh nghiệp", "cá nhân"],
        "Bạn có thể cho biết đối tượng cụ thể (cá nhân/tổ chức/doanh nghiệp)?",
        r"(?iU)\b(công dân|doanh nghiệp|hộ gia đình|cá nhân|tổ chức|công ty|cơ quan)\b",
    ),
    (
        "case",
        ["trường hợp", "tình huống", "nếu", "khi nào"],
        "Bạn có thể mô tả cụ thể trường hợp/tình huống của bạn?",
        None,
    ),
    (
        "document",
        ["văn bản", "nghị định", "thông tư", "luật", "quy định"],
        "Bạn muốn hỏi về văn bản pháp luật nào cụ thể?",
        None,
    ),
]
# Fixed value: question for queries that are merely short.
DETAIL_QUESTION = "Bạn có thể mô tả chi tiết hơn về câu hỏi?"

# Keyword groups that choose the gate's question.
LOCATION_WORDS = ["tỉnh", "huyện", "xã", "địa phương", "thành phố"]
TIME_WORDS = ["năm", "tháng", "ngày", "khi", "thời điểm"]
SUBJECT_WORDS = ["ai", "đối tượng", "người", "tổ chức"]
LOCATION_QUESTION = "Bạn đang hỏi về địa phương/khu vực nào cụ thể?"
TIME_QUESTION = "Bạn đang hỏi về thời điểm nào cụ thể?"
SUBJECT_QUESTION = "Bạn có thể cho biết đối tượng cụ thể được không?"
AMBIGUOUS_QUESTION = "Bạn có thể cho biết thêm chi tiết về câu hỏi?"

# Words that choose the fallback's question, and its default.
GENERIC_QUESTIONS = [
    (["ai", "thẩm quyền"], "Bạn muốn hỏi về thẩm quyền của cơ quan/cấp nào cụ thể?"),
    (["như thế nào", "thủ tục"], "Bạn có thể cho biết cụ thể loại thủ tục/dịch vụ bạn muốn tìm hiểu?"),
    (["bao nhiêu", "mức"], "Bạn đang hỏi về mức phí/thời gian/số lượng cụ thể nào?"),
]
GENERIC_DEFAULT = "Bạn có thể cung cấp thêm thông tin chi tiết về câu hỏi?"

# ---- fallback texts ---------------------------------------------------------
# Texts of fallback answers.
CAUTIOUS_PREFIX = (
    "Dựa trên các văn bản được cung cấp, tôi tìm thấy một số thông tin có thể liên quan:"
)
CAUTIOUS_WARNING = (
    "⚠️ **Lưu ý**: Tôi chưa tìm thấy điều khoản trực tiếp quy định về vấn đề bạn hỏi. "
    "Thông tin trên chỉ mang tính tham khảo. Vui lòng tham vấn chuyên gia pháp lý để được tư vấn chính xác."
)
SHORT_WARNING = "⚠️ Lưu ý: Vui lòng kiểm tra lại với văn bản gốc."
NO_INFO = "Tôi không tìm thấy thông tin liên quan trong các văn bản pháp luật được cung cấp."
RETRY_HINT = "💡 Gợi ý: Bạn có thể thử hỏi cách khác hoặc cung cấp thêm ngữ cảnh."
NEED_MORE = "Tôi cần thêm thông tin để trả lời chính xác."
FOUND_IN = "Thông tin liên quan tìm thấy trong "

# ---- scope and follow-up ----------------------------------------------------
# Domain words that keep a query in scope.
SCOPE_KEYWORDS = [
    "luật", "pháp luật", "nghị định", "nghị quyết", "thông tư", "quy định",
    "điều", "khoản", "điểm", "chương", "thẩm quyền", "phân quyền", "phân cấp",
    "chính quyền", "địa phương", "ủy ban", "ubnd", "chủ tịch", "bộ", "sở",
    "cơ quan", "xã", "phường", "tỉnh", "huyện", "sáp nhập", "hộ tịch",
    "khai sinh", "nuôi con nuôi", "thủ tục", "hồ sơ", "cấp giấy", "y tế",
    "nội vụ", "tư pháp", "tài chính", "xây dựng", "đất đai", "thống kê",
    "công thương", "nông nghiệp", "môi trường", "chính phủ", "quốc hội",
]
# Marks of chatter that is out of scope.
OUT_OF_SCOPE_MARKERS = [
    "con gì", "là con gì", "mấy vậy", "bằng mấy", "1+1", "2+2",
    "ăn gì", "uống gì", "thời tiết", "bóng đá",
]
# Marks of a question that leans on the one before it.
FOLLOW_UP_MARKERS = [
    "thế còn", "vậy còn", "còn", "thủ tục đó", "việc đó", "trường hợp đó",
    "cái đó", "nó", "đó", "như vậy", "mất bao lâu", "cần giấy tờ gì",
]
# Text put around a follow-up question.
FOLLOW_UP_BEFORE = "Câu hỏi trước: "
FOLLOW_UP_AFTER = "Câu hỏi tiếp nối cần trả lời đầy đủ: "

# ---- answers ----------------------------------------------------------------
# An answer that is only a refusal.
REFUSALS = ["abstain", "[abstain]", "abstain.", "tôi không biết.", "không tìm thấy."]
# Refusal phrases looked for in short answers.
ABSTAIN_MARKERS = [
    "không tìm thấy", "không đủ căn cứ", "không có thông tin",
    "thiếu thông tin", "không thể xác định", "cần thêm thông tin",
    "không có quy định", "không được đề cập", "không có dữ liệu",
    "không liên quan", "không cung cấp", "không thuộc phạm vi",
    "not provided", "not found", "no information", "cannot answer",
    "cannot determine", "no relevant", "not mentioned",
    "i cannot", "i am unable", "not available", "no specific provision",
]
# Citation patterns in answer text.
ARTICLE_CITE = r"(?:Điều|điều)(?:\s+số)?\s*(\d+[a-z]?)"
CLAUSE_CITE = r"(?:Khoản|khoản)(?:\s+số)?\s*(\d+)"
POINT_CITE = r"(?:Điểm|điểm)(?:\s+số)?\s*([a-zđ])"
# Headings of the conclusion and of the citation list.
CONCLUSION_PATTERN = (
    r"(?is)(?:\*\*)?(?:Kết luận|Câu trả lời|Trả lời|Answer|Kết quả)(?:\*\*)?[:\s\-]*"
    r"(.+?)(?:\n\n|\n\*\*|\nTrích dẫn|$)"
)
CITATION_HEADING = r"(?is)^(.*?)\n\s*(?:Trích dẫn|Căn cứ pháp lý|📎 \*\*Trích dẫn:\*\*)\s*\n"

# Patterns of reading errors and what replaces them, before and after the list of replacements.
REPAIRS_BEFORE = [(r"\n[lI]\.\s", "\n1. "), (r"(?U)\bS0\b", "SỐ")]
REPAIRS_AFTER = [(r"[|¬~`]", ""), (r"-\s*\n\s*", "")]

# ---- text cleaning ----------------------------------------------------------
# Fixed value: page lines dropped when pages are merged.
PAGE_NOISE = r"(?i)^(VGP|CÔNG THÔNG TIN|Trang \d+|Page \d+)"
# Reading errors and their repair, applied in order.
OCR_REPLACEMENTS = [
    ("NGH! D!NH", "NGHỊ ĐỊNH"),
    ("QUYET D!NH", "QUYẾT ĐỊNH"),
    ("THONG TU", "THÔNG TƯ"),
    ("C0NG", "CỘNG"),
    ("H0A", "HÒA"),
    ("XA HOI", "XÃ HỘI"),
    ("CHU NGHIA", "CHỦ NGHĨA"),
    ("VIET NAM", "VIỆT NAM"),
    ("DOC LAP", "ĐỘC LẬP"),
    ("TU DO", "TỰ DO"),
    ("HANH PHUC", "HẠNH PHÚC"),
    ("Diêu", "Điều"),
    ("Dicu", "Điều"),
    ("Điêu", "Điều"),
]
# Legal terms of which two must occur in a merged text.
GATE_TERMS = [
    "căn cứ", "điều", "khoản", "nghị định", "quyết định", "thông tư", "ủy ban nhân dân", "chính phủ",
    "can cu", "cän cu", "dieu", "diéu", "diều", "khoan", "nghi dinh", "quyet dinh", "thong tu",
    "uy ban nhan dan", "chinh phu",
]
# Document types by priority, issuing-body boilerplate, motto.
DOC_TYPES = ["NGHỊ ĐỊNH", "QUYẾT ĐỊNH", "THÔNG TƯ", "LUẬT", "NGHỊ QUYẾT", "CHỈ THỊ", "PHÁP LỆNH"]
HEADER_BOILERPLATE = ["CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "CONG HOA XA HOI", ""]
HEADER_NOISE = ["NGƯỜI KÝ", "Email", "Thời gian", "Cơ quan:"]
MOTTOS = ["Độc lập", "ĐỘC LẬP"]
# Header patterns.
NUMBER_HEADER = r"(?i)Số:\s*([^\s\n\r]+)"
DATE_HEADER = r"(?iU)ngày\s+(\d+)\s+tháng\s+(\d+)\s+năm\s+(\d+)"
NUMBER_HEADER_V2 = r"(?iU)Số:\s*(\d+[/\d\w\-]+)"
TYPE_HEADER_V2 = r"(?iU)(NGHỊ ĐỊNH|QUYẾT ĐỊNH|THÔNG TƯ|LUẬT|PHÁP LỆNH)"
DATE_HEADER_V2 = r"(?iU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
ISSUER_MARKS_V2 = ["Cơ quan phát hành:", "CHÍNH PHỦ"]
# Signs of broken characters, and the characters allowed in a text.
NOISE_MARKERS = ["�", "□", "@@@"]
ALLOWED_CHARS = r"\p{L}\p{N}_\s\.,;:()\-/–—“”\"\[\]{}%+"

# ---- structure lines --------------------------------------------------------
# Line patterns of the legal hierarchy, reading errors included.
CHAPTER_LINE = r"(?iU)^\s*(?:Chương|Chuong)\s+([IVXLCDM0-9]+)"
SECTION_LINE = r"(?iU)^\s*(?:Mục|Muc)\s+(\d+)"
ARTICLE_LINE = r"(?iU)^\s*(?:Điều|Diu|Diều|Biều|Ðiều|Diéu|Dieu|Diêu)\s+(\d+)\.[\s\t]*(.*)$"
CLAUSE_LINE = r"^\s*(\d{1,2})\.[\s\t]*(.*)$"
POINT_LINE = r"^\s*([a-zA-ZđĐ])\)\s*(.*)$"
APPENDIX_LINE = r"(?iU)^\s*(?:Phụ\s+lục|Phu\s+luc)\b"
APPENDIX_REFERENCES = ["kèm theo", "ban hành", "tại khoản"]
DOC_TYPE_LINE = (
    r"(?iU)^\s*(LUẬT|BỘ LUẬT|NGHỊ ĐỊNH|NGHI DINH|THÔNG TƯ|THONG TU|QUYẾT ĐỊNH|QUYET DINH|"
    r"NGHỊ QUYẾT|NGHI QUYET|CHỈ THỊ|PHÁP LỆNH)\b"
)
HEADER_STOP_LINE = r"(?iU)^\s*(Căn cứ|Điều|Kính gửi)\b"
FOOTER_LINE = r"(?iU)^\s*(Nơi nhận:|TM\.|KT\.|PP\.)"
NUMBER_LINE = r"^\s*\d+\s*$"
HEADER_TRASH_LINE = (
    r"(?iU)^\s*(NGƯỜI KÝ|Email|Thời gian ký|Cơ quan:|Page|source|CỘNG HÒA|Độc lập|Hạnh phúc|Số:|Hà Nội,)"
)
PAGE_MARKER_LINE = r"(?i)^\[PAGE_(\d+)\]$"
CHAPTER_REFERENCE_WORDS = ["của", "tại", "theo", "trong", "luật", "nghị định"]
DEFAULT_CHAPTER = "0"
DEFAULT_CHAPTER_NAME = "QUY ĐỊNH CHUNG"
UNKNOWN_TITLE = "Không xác định"
# Line patterns of the flat and of the second parser.
FLAT_ARTICLE_LINE = r"(?iU)^(?:Điều)\s+(\d+[\w]*)[\.:]?\s*(.*)"
FLAT_CLAUSE_LINE = r"^(\d+)\.\s+(.*)"
FLAT_POINT_LINE = r"(?iU)^([a-z]|[đ])\)\s+(.*)"
V2_BASIS_LINE = r"(?iU)^Căn cứ\s+"
V2_CHAPTER_LINE = r"(?iU)^(?:Chương)\s+([IVXLCDM]+|[\dA-Z]+)[\.:]?\s*(.*)"
V2_ARTICLE_LINE = r"(?iU)^(?:Điều)\s+(\d+[\w]*)[\.:]\s*(.*)"
V2_REFERENCE = r"(?iU)^(Nghị quyết|Nghị định|Quyết định|Thông tư|Luật|Pháp lệnh|NĐ-CP|QH\d+)"
V2_CLAUSE_LINE = r"^(\d+)\.\s+(.+)"
V2_POINT_LINE = r"(?iU)^([a-z]|đ|1)\)\s+(.*)"

# ---- retrieval boosts -------------------------------------------------------
# Phrases and amounts of the three topics.
TRANSFER_PHRASES = [
    ("hồ sơ thủ tục hành chính", 0.12),
    ("cơ quan cấp huyện đang giải quyết", 0.12),
    ("cấp huyện đang giải quyết", 0.12),
    ("tiếp tục giải quyết", 0.10),
    ("không làm gián đoạn", 0.08),
    ("cơ quan thuộc cấp xã", 0.08),
    ("cấp xã nơi cư trú", 0.08),
    ("nơi đặt trụ sở", 0.06),
    ("không phải làm lại giấy tờ", 0.06),
    ("phân định thẩm quyền từ cấp huyện cho cấp xã hoặc cấp tỉnh", 0.06),
]
TRANSFER_TRIGGERS = [
    ["lên huyện", "cấp huyện", "huyện làm thủ tục"],
    ["thủ tục", "hồ sơ", "đến đâu"],
]
CIVIL_PHRASES = [
    ("đăng ký khai sinh", 0.12),
    ("hồ sơ đăng ký hộ tịch", 0.12),
    ("đăng ký hộ tịch", 0.10),
    ("cơ quan đăng ký hộ tịch", 0.10),
    ("ủy ban nhân dân cấp xã", 0.08),
    ("ubnd cấp xã", 0.08),
]
CIVIL_TRIGGERS = [["khai sinh", "giấy khai sinh", "hộ tịch"]]
CIVIL_MUST = ["đăng ký khai sinh", "hồ sơ đăng ký hộ tịch", "cơ quan đăng ký hộ tịch"]
MERGER_PHRASES = [
    ("nghị quyết số: 202/2025/qh15", 0.25),
    ("sắp xếp toàn bộ diện tích tự nhiên", 0.18),
    ("thành tỉnh mới có tên gọi", 0.15),
    ("sắp xếp đơn vị hành chính cấp tỉnh", 0.12),
]
MERGER_MARKERS = [
    "sáp nhập", "sắp xếp", "xác nhập", "nhập với", "tỉnh nào",
    "diện tích", "dân số", "thành tỉnh", "sau sáp nhập",
]
MERGER_SOURCE = "nghị quyết số: 202/2025/qh15"
MERGER_GROUP_PLACE = "hồ chí minh"
MERGER_GROUP = [
    "sắp xếp toàn bộ diện tích tự nhiên, quy mô dân số của thành phố hồ chí minh",
    "tỉnh bà rịa - vũng tàu",
    "tỉnh bình dương thành",
]
# Place names.
PLACES = [
    "bình dương", "bình phước", "bình thuận", "đà nẵng", "quảng nam", "quảng ngãi", "bà rịa - vũng tàu",
    "bà rịa vũng tàu", "bà rịa", "vũng tàu",
    "hồ chí minh", "hải phòng", "hải dương", "quảng ninh", "tuyên quang",
    "hà giang", "phú thọ", "vĩnh phúc", "thái bình", "hà nam", "nam định",
    "ninh bình", "hòa bình", "thanh hóa", "nghệ an", "hà tĩnh", "huế",
    "đồng nai", "đồng tháp", "lâm đồng", "tây ninh", "vĩnh long", "bến tre",
    "trà vinh", "sóc trăng", "bạc liêu", "cà mau", "kiên giang", "an giang",
    "hậu giang", "cần thơ", "cao bằng", "điện biên", "lai châu", "lạng sơn",
    "sơn la", "lào cai", "yên bái", "bắc kạn", "thái nguyên", "bắc giang",
    "bắc ninh", "hưng yên", "quảng bình", "quảng trị", "kon tum", "gia lai",
    "bình định", "ninh thuận", "khánh hòa", "đắk nông", "đắk lắk", "phú yên",
    "long an", "tiền giang",
]
# Amounts and limits of boosts and of the rerank decision.
PLACE_BOOST = 0.08
NUMBER_BOOST = 0.04
GROUP_BOOST = 0.70
GROUP_BONUS = 0.80
PLACES_BONUS = 0.35
MUST_SCORE = 0.50
MERGER_SCORE = 0.90
MERGER_GROUP_SCORE = 1.30
RRF_K = 60
SKIP_STRONG_DENSE, SKIP_STRONG_MARGIN = 0.50, 0.08
SKIP_DENSE, SKIP_DENSE_MARGIN = 0.70, 0.10
SKIP_RRF, SKIP_RRF_MARGIN = 0.0320, 0.0004
PROXY_SCORE, PROXY_STEP, PROXY_DENSE = 8.0, 0.05, 0.01
BYPASS_BEST, BYPASS_KEYWORD, BYPASS_DENSE = 0.15, 10.0, 0.45

# ---- gate profiles ----------------------------------------------------------
# Thresholds of the default gate and of the four presets.
GATE_DEFAULT = {
    "threshold_pass": 2.0, "threshold_abstain": 0.5, "threshold_cautious": 1.0,
    "margin_min": 0.003, "margin_scale": 50.0,
    "tier_local_min_score": 6.0, "tier_local_min_margin": 0.03, "tier_api_min_score": 0.0,
    "min_keyword_coverage": 0.3, "min_lexical_overlap": 0.15,
    "require_legal_keyword": False, "enable_ask_back": True,
    "ask_back_on_ambiguous": True, "score_is_sigmoid": False,
}
GATE_PRESETS = {
    "sigmoid": {
        "threshold_pass": 0.5, "threshold_abstain": 0.05, "threshold_cautious": 0.3,
        "margin_min": 0.001, "margin_scale": 100.0,
        "tier_local_min_score": 0.9, "tier_local_min_margin": 0.005, "tier_api_min_score": 0.05,
        "enable_ask_back": False, "score_is_sigmoid": True,
    },
    "local_first": {
        "threshold_pass": 2.0, "threshold_abstain": -5.0, "threshold_cautious": -1.0,
        "margin_min": 0.001, "margin_scale": 50.0,
        "tier_local_min_score": 3.0, "tier_local_min_margin": 0.005, "tier_api_min_score": -1.0,
        "enable_ask_back": False,
    },
    "pair_score": {
        "threshold_pass": 3.0, "threshold_abstain": -5.0, "threshold_cautious": 0.0,
        "margin_min": 0.003, "margin_scale": 50.0,
        "tier_local_min_score": 8.0, "tier_local_min_margin": 0.03, "tier_api_min_score": -5.0,
        "enable_ask_back": False,
    },
    "dense_only": {
        "threshold_pass": 0.8, "threshold_abstain": 0.2, "threshold_cautious": 0.4,
        "margin_min": 0.01, "margin_scale": 20.0,
        "tier_local_min_score": 0.9, "tier_local_min_margin": 0.05, "tier_api_min_score": 0.2,
        "enable_ask_back": False, "score_is_sigmoid": True,
    },
}

# ---- service ----------------------------------------------------------------
# Progress marks of an ingest log, by step.
PROGRESS_RULES = [
    (1, ["Step 1:", "Validating PDF"]),
    (2, ["Step 2:", "Extraction", "Running OCR"]),
    (3, ["Step 3:", "Merging", "Cleaning"]),
    (3, ["Step 4:", "Parse", "Legal Document Structure"]),
    (4, ["Step 5:", "Document Chunking", ("Generated", "chunks")]),
    (5, ["Step 6:", "Embedding", "Encoding"]),
    (5, ["Step 7:", "Committing to Production", "Production vector store"]),
]
RATE_LIMIT_REQUESTS, RATE_LIMIT_SECONDS, RATE_LIMIT_PREFIX = 30, 60, "/api/"
DEFAULT_CHAT_TITLE = "New Conversation"

# Columns of a query log row, in file order.
LOG_COLUMNS = [
    "timestamp", "run_date", "query_id", "query",
    "top_k_retrieve", "max_ce_candidates", "threshold_pass", "tier_local_min_score",
    "tier", "tier_reason",
    "gating_decision", "gating_reason", "gating_confidence",
    "confidence_final", "semantic_similarity", "lexical_overlap",
    "query_type", "context_token_length",
    "score_rerank_top1", "score_rerank_top2", "margin",
    "score_retrieval_top1",
    "num_chunks_retrieved", "num_chunks_after_dedup",
    "top1_chunk_id", "top1_text_preview",
    "llm_backend", "llm_model",
    "generated_answer", "answer_length",
    "num_citations", "citations_str", "citation_hit",
    "latency_retrieve_ms", "latency_rerank_ms",
    "latency_context_ms", "latency_llm_ms", "latency_total_ms",
    "api_failed", "fallback_to_local", "retry_count",
    "error", "status",
]

# Context part of the user prompt, its headings and requirements.
PROMPT_CONTEXT = "## CONTEXT (Các đoạn văn bản pháp lý):\n"
PROMPT_QUESTION = "## CÂU HỎI:\n"
PROMPT_REQUIREMENTS = (
    "## YÊU CẦU:\n"
    "- Trả lời dựa TRÊN VÀ CHỈ DỰA TRÊN context ở trên\n"
    "- Trích dẫn cụ thể Điều/Khoản/Điểm\n"
    "- Nếu context không đủ thông tin → abstain=true\n"
    "- Nếu câu hỏi hỏi chung về việc thủ tục trước đây thuộc cấp huyện nay đến đâu, và context có quy định "
    "chuyển thẩm quyền/hồ sơ sang cấp xã hoặc cấp tỉnh, hãy trả lời theo điều kiện trong context thay vì "
    "abstain chỉ vì thiếu tên thủ tục cụ thể."
)
PROMPT_JSON = "\n\nHãy trả về kết quả dưới định dạng JSON như đã hướng dẫn."
PROMPT_CUT = "\n[...context đã rút gọn...]\n\n"
PROMPT_MARKER = "## CÂU HỎI"

# ---- tidying ----------------------------------------------------------------
# Patterns and replacements, in this order, applied after something was cut out of a text.
TIDY_PATTERNS = [
    (r"\s+([,.;:!?])", "$1"),
    (r"([,.;:!?])\s*\1+", "$1"),
    (r"\s+([;:])", "$1"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
]
