"""Fixed values. Results are only right when these are exactly as given."""

# --- character classes of the compound rules -------------------------------
ORDINAL_MARK = "第"
NUMERALS = "零一二三四五六七八九十百千万两半几"
FUNCTION_PREFIXES = "不没很太更最也都还就才又挺别这那哪每大小真好先多"
VERB_PREFIXES = "吃喝看做写坐用洗想走来放带买开变去打"
PRONOUN_PREFIXES = "我你他她"
MEASURE_PREFIXES = "个本件条杯瓶包块种些篇首场次回遍声句幅双套间颗只段"
NAME_RISK_PREFIXES = "大小老"
ASPECT_SUFFIXES = "了得"
SILENT_SUFFIX = "儿"
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗郑梁谢宋唐许邓冯韩曹彭曾萧田董袁潘于蒋蔡余杜叶"
    "程苏魏吕丁沈任姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾"
    "毛郝龚邵万钱严覃武戴莫孔向汤"
)

# --- names of the rule that resolved a compound ----------------------------
PATTERN_SINGLE = "single_char_via_doubled_form"
PATTERN_ORDINAL = "ordinal"
PATTERN_REDUPLICATION = "reduplication"
PATTERN_AABB = "aabb_reduplication"
PATTERN_ERHUA = "erhua_suffix"
PATTERN_NUMERAL = "pure_numeral"
PATTERN_NUMERAL_UNIT = "numeral_plus_unit"
PATTERN_VERB = "verb_prefix"
PATTERN_PRONOUN = "pronoun_prefix"
PATTERN_MEASURE = "measure_word"
PATTERN_FUNCTION = "function_prefix"
PATTERN_ASPECT = "aspect_suffix"
PATTERN_TWO_WORDS = "two_word_compound"

# --- file names --------------------------------------------------------------
EXAM_NAME = r"(?i)^(H([34])\d{4}[A-Z]?)"
YEAR_IN_NAME = r"(20\d{2})"
LEVEL_IN_NAME = r"(?i)HSK(\d)"
COPY_MARKS = (("_copy", 10), ("-audio", 10), ("试卷", 5), ("(1)", 3))
INSTRUCTION_MARKS = ("exam-paper", "试卷")
INVENTORY_EXTENSIONS = ("pdf", "mp3", "wav", "m4a", "flac")

# --- extraction quality --------------------------------------------------------
MIN_CHARS_PER_PAGE = 150
ARTEFACT = r"\(cid:\d+\)"
MAX_ARTEFACTS = 10
METHOD_TEXT_LAYER = "pdfplumber"
METHOD_SCANNED = "OCR (scanned)"
METHOD_SPARSE = "OCR (sparse fix)"
METHOD_ARTEFACT = "OCR (cid fix)"
LENGTH_BINS = ((0, 600, "<600"), (600, 4000, "600-4k"), (4000, 7000, "4k-7k"), (7000, 20000, ">7k"))

# --- completeness -----------------------------------------------------------------
SECTION_HEADING = "第[一二三四五六七八九十]+部分"
QUESTION_NUMBER = r"(?<!\d)(\d{1,2})(?=\s*[．。、）\)\.]\s*[一-鿿])"
EXPECTED_SECTIONS = 3
EXPECTED_QUESTIONS = {3: 40, 4: 45}
LAST_QUESTION = 60
QUESTION_SHARE = 0.8
NOTICE_HEADER = r"注\s*意"
SKILL_WORDS = (("has_listening", "听力", r"听\s*力"),
               ("has_reading", "阅读", r"阅\s*读"),
               ("has_writing", "书写", r"书\s*写"))
NOTICE_ITEM = "[一二三][、，。]"
EXPECTED_ITEMS = 3

# --- text cleaning ------------------------------------------------------------------
REPEAT_SHORTEST = 4
REPEAT_LONGEST = 200
CLAUSE_ENDS = ",。!?、;"
CLAUSE_BLOCK = 8
CLAUSE_SHORTEST = 4
CLAUSE_SIMILARITY = 0.82
TRADITIONAL_MARKERS = ("什麼", "題", "沒", "嗎", "我們", "裡", "麵", "這", "說")
HAN = "一-鿿"

# --- sentences ----------------------------------------------------------------------
SENTENCE_ENDS = "。！？!?；;"
NUMBER_SEPARATORS = ".．、，,:："
EXAMPLE_LEAD = "例如"
HAN_NUMBERS = "一二三四五六七八九十"
DIGITS = "0-9０-９"
OPTION_LETTERS = "A-EＡ-Ｅ"
LEAD_CLUSTER = r"★☆•·▲←↑→↓□（）()\[\]【】“”\"'－—\-.．、，,:：？?！!。；;"
MIN_SCRIPT_CHARS = 6
MAX_SENTENCE = 80
MIN_SCRIPT_SHARE = 0.6
BOILERPLATE_EXAMS = 3
BEST_EXAMPLE_LENGTH = 20
MAX_EXAMPLES = 10

# --- review -----------------------------------------------------------------------------
NOISE_MAX_COUNT = 2
NOISE_EXAMS = 1

# --- query limits ---------------------------------------------------------------------
LEVELS = (1, 9)
LIST_LEVELS = (1, 2, 3, 4, 5, 6)
SOURCE_TYPES = ("reading", "listening")
TOP_LIMIT = (1, 10000)
COMPARE_LIMIT = (1, 500)
QUERY_LENGTH = (1, 50)
PAGE_SIZE = 10
WORDLIST_COLUMNS = ("id", "word", "pinyin", "definition", "definition_th", "level",
                    "example_sentence", "example_pinyin")
