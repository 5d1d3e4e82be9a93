"""Results are only right when these equal the published ones.

Word lists, thresholds, patterns and formats, in their natural order.
"""

# ---- characters ---------------------------------------------------------------
# What counts as white space when text is stripped or split into words.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set as a regular-expression class body, readable by Java and RE2.
WHITESPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
CJK_CLASS = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
SOURCE_SCRIPT_CLASS = r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}"
SPOKEN_CJK_CLASS = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
ARTEFACT_CLASS = r",.。，、!！?？"
BREAK_SENTENCE = "。！？!?…"
BREAK_CLAUSE = "，,、；;：:"
BREAK_SPACE = " "
QUOTES = "\"“”"

# ---- recogniser ---------------------------------------------------------------
CHUNK_MS = 900_000
SNAP_MS = 45_000
TAIL_MS = 30_000
LEAD_MS = 2_500
MAX_UPLOAD_BYTES = 24 * 1024 * 1024
MIN_CHUNK_MS = 30_000
COLLAPSED_MS = 8_000
COLLAPSED_RATIO = 0.55
COLLAPSED_MIN_WORDS = 6
MAX_REPAIRS = 40
REPAIR_LEAD_MS = 300
REPAIR_PAD_MS = 600
MERGE_SPAN_MS = 7_000
MERGE_GAP_MS = 400
MERGE_CHARS = 44
LANGUAGE_CODES = {
    "chinese": "zh", "mandarin": "zh", "vietnamese": "vi", "japanese": "ja",
    "korean": "ko", "thai": "th", "english": "en", "spanish": "es",
    "french": "fr", "german": "de", "russian": "ru", "portuguese": "pt",
    "indonesian": "id", "hindi": "hi", "arabic": "ar", "italian": "it",
}
LANGUAGE_NAMES = {
    "zh": "Mandarin Chinese", "ja": "Japanese", "ko": "Korean", "es": "Spanish",
    "fr": "French", "de": "German", "ru": "Russian", "ar": "Arabic",
    "hi": "Hindi", "pt": "Portuguese", "it": "Italian", "vi": "Vietnamese",
    "th": "Thai", "id": "Indonesian", "en": "English",
}
UNKNOWN_LANGUAGE = "the source language"
FILLER_LINES = (
    "字幕由amara.org社群提供", "字幕由Amara.org社群提供", "由 Amara.org 社群提供的字幕",
    "请不吝点赞 订阅 转发 打赏支持明镜与点点栏目", "謝謝觀看", "谢谢观看",
    "MING PAO CANADA", "Thanks for watching!", "感謝您的收看",
)

# ---- translation batches --------------------------------------------------------
BATCH_LINES = 30
CONTEXT_LINES = 3
REAL_LINE_CHARS = 8
CHARS_PER_SECOND = 15
MIN_BUDGET_CHARS = 12
MIN_SPAN_MS = 400
DEFAULT_HEADROOM = 8_000
REASONING_MULTIPLE = 2
SAMPLE_LINES = 110
SAMPLE_BUDGET = 3_200
SAMPLE_MIN_CHARS = 24
OPENING_LINES = 55

# ---- audit -----------------------------------------------------------------------
OVER_BUDGET = 1.55
EXPANSION_CJK = 1.20
EXPANSION_LATIN = 0.42
UNDERFILL = 0.55
MIN_SOURCE_CHARS = 10
NARRATED_SHARE = 0.40
NARRATED_MIN_LINES = 12
REPAIR_GROUP = 20
NARRATED_MARKERS = ("narrator and main character", "THE MAIN CHARACTER is")
SECOND_PERSON_WORDS = "you|your|yours|yourself|yourselves|you're|you'd|you've|you'll"
CLASH_PHRASES = "his husband|his wives|her wife"
DANGLING_WORDS = ("and|but|so|then|the|an?|to|of|with|that|because|as|for|if|when|"
                  "while|is|was|were")

# ---- cast ------------------------------------------------------------------------
PRONOUNS_SOURCE = (
    "你", "妳", "您", "我", "他", "她", "它", "牠", "咱",
    "你们", "你們", "我们", "我們", "他们", "他們", "她们", "她們",
    "自己", "大家", "别人", "別人",
    "ta", "nguoi", "người", "ngươi", "han", "hắn", "nang", "nàng",
    "chang", "chàng", "toi", "tôi", "minh", "mình", "y", "gã", "ga",
)
PRONOUNS_ENGLISH = (
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself",
    "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "we", "us", "our", "ours", "they", "them", "their",
    "oneself", "self", "everyone", "others",
)
GENERIC_NAMES = (
    "wife", "wives", "husband", "spouse", "concubine", "bride", "brides",
    "host", "master", "mistress", "lord", "lady", "ladies", "madam", "sir",
    "mother", "father", "mom", "dad", "parents", "son", "sons", "daughter",
    "daughters", "brother", "brothers", "sister", "sisters", "aunt", "uncle",
    "grandfather", "grandmother", "elder", "elders", "senior", "junior",
    "child", "children", "girl", "girls", "boy", "boys", "woman", "women",
    "man", "men", "people", "everyone", "villager", "villagers", "crowd",
    "chief", "system", "narrator", "protagonist", "friend", "friends",
    "the three women", "three daughters", "little star", "little stars",
)
FEMALE_WORDS = (
    "wife", "wives", "mother", "mom", "mum", "daughter", "sister", "aunt",
    "grandmother", "granddaughter", "niece", "madam", "lady", "girl", "queen",
    "empress", "princess", "saintess", "priestess", "widow", "bride",
    "girlfriend", "fiancee", "concubine", "maid", "actress",
    "stepsister", "stepmother", "mistress", "nun",
)
MALE_WORDS = (
    "husband", "father", "dad", "son", "brother", "uncle", "grandfather",
    "grandson", "nephew", "sir", "lord", "boy", "king", "emperor", "prince",
    "monk", "groom", "boyfriend", "fiance", "master", "man",
    "stepbrother", "stepfather", "gentleman",
)
FEMALE_NAME_CHARS = "婉柔娟婷芳丽娜雅秀淑静洁玲燕莉妍姗媛琳蕾萍慧敏兰梅菊凤妃姬嫣娥娇妤婕瑶珊薇茜蓉颖怡妮娅莹璐岚彤霞黛娴"
MALE_NAME_CHARS = "强伟军刚勇峰磊涛龙虎昊杰豪雄栋铭钢钧霆霸擎骁锋岳猛冲彪坤"
MAX_SPELLINGS = 6
MAX_RELATION = 80
MAX_CAST_ROW = 200
MAX_CHART_ROWS = 30

# ---- timing ----------------------------------------------------------------------
SAMPLE_RATE = 24_000
BREATH_SENTENCE_MS = 300
BREATH_CLAUSE_MS = 170
BREATH_RUNON_MS = 90
MIN_GAP_MS = 60
MIN_SLOT_MS = 350
MIN_PLAN_GAP_MS = 300
BREATH_TEMPO = 1.25
NATIVE_FIT = 1.02
NATIVE_CAP = 1.35
TEMPO_CEIL = 1.55
RESCUE_TEMPO = 1.9
RESCUE_TOTAL = 2.15
SEPARATION_MS = 40
MIN_LIMIT_MS = 200
CLIP_SLACK_MS = 10
DEFAULT_MAX_SPEEDUP = 1.7

# ---- downloads -------------------------------------------------------------------
VIDEO_CODEC_RANK = ("avc1", "av01", "vp09", "vp9")
AUDIO_KBPS_LARGE = 128
AUDIO_KBPS_SMALL = 48
AUDIO_LARGE_FROM_HEIGHT = 360
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v", ".mpg", ".mpeg",
                    ".ts", ".flv", ".wmv")
SOURCE_EXTENSIONS = (".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v")

# ---- models and voices ---------------------------------------------------------------
MODEL_SKIP = ("prompt-guard", "safeguard", "orpheus", "-tts", "guard-")
MODEL_PREFERENCE = ("qwen", "kimi", "llama-3.3", "gpt-oss-120", "deepseek", "llama-4")
MODEL_UNFIT_HELPER = ("compound", "allam")
REASONING_MODEL = r"(?i)gpt-oss|deepseek-r1|reason|think"
LOCALE_ORDER = ("en-US", "en-GB", "en-AU", "en-CA", "en-IE")
DEFAULT_BASE_VOICE = "en-US-AndrewMultilingualNeural"

# ---- windows -------------------------------------------------------------------------
WINDOW_CAP_MS = 300_000
SEGMENT_MS = 6_000
