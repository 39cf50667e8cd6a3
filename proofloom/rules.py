"""Rule packs: the patterns, word lists and tables that operators take as input. They are data; replace them freely."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Severities with their weight in ordering and in scoring, categories with their dimension.
SEVERITY_ORDER = {"FATAL": 100, "MAJOR": 20, "MINOR": 5, "INFO": 1}
SEVERITY_SCORE = {"FATAL": 100.0, "MAJOR": 20.0, "MINOR": 5.0, "INFO": 0.5}
DIMENSION_OF = {"term": "terminology", "political": "terminology", "language": "language", "format": "language", "logic": "logic", "data": "academic", "duplicate": "academic", "reference": "academic", "style": "style"}
DIMENSIONS = {"terminology": (150.0, 0.35), "language": (130.0, 0.18), "logic": (200.0, 0.17), "academic": (200.0, 0.25), "style": (120.0, 0.05)}  # scale, weight


@dataclass(frozen=True)
class Term:
    id: str
    term: str
    variants: tuple[str, ...] = ()
    type: str = "literal"  # literal, ordering, semantic, deprecated
    severity: str = "MAJOR"
    order: tuple[str, ...] = ()
    segment: str = ""
    replaces: str = ""
    priority: int = 0
    source: str = "core"
    tags: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    confidence: float = 0.95
    version: str = "1"
    explain: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str = "MINOR"
    category: str = "language"
    message: str = ""
    replacement: str | None = None  # may hold $1
    advice: str = ""
    confidence: float = 0.8
    allow_context: tuple[str, ...] = ()
    fix: str = ""  # how a suggestion is made, see norm.FIXES; with a replacement: "replace"


#: Marks that stand in pairs, and Latin words that may touch CJK characters, in lower case.
PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("‘", "’"), ("（", "）"), ("《", "》"), ("【", "】"))
CLOSED_UP = ("api", "app", "cpu", "gpu", "html", "http", "https", "java", "json", "linux", "pdf", "python", "sql", "url", "web", "xml")


@dataclass(frozen=True)
class Pack:
    name: str
    terminators: str
    closers: str
    heading: str
    reference_head: str
    negation: tuple[str, ...]
    terms: tuple[Term, ...] = ()
    language: tuple[Rule, ...] = ()
    banned: tuple[Rule, ...] = ()
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    quantifiers: tuple[tuple[str, float, float, str], ...] = ()
    metrics: tuple[tuple[str, float, float], ...] = ()
    repeats: tuple[Rule, ...] = ()  # suggestions are the first half of a match
    pairs: tuple[tuple[str, str], ...] = PAIRS
    cues: tuple[str, ...] = ()
    unit: str = r"%|\p{L}+"
    magnitudes: str = "万亿"  # characters of large numbers, which are not part of a unit
    closed_up: tuple[str, ...] = CLOSED_UP
    sections: tuple[str, ...] = ()
    publishers: tuple[str, ...] = ()


LATIN = Pack(
    name="latin",
    magnitudes="",
    terminators=".!?;\\n",
    closers="\"')\\]",
    heading=r"^\s*(#{1,6}\s|\p{Lu}[^.!?]*$)",
    reference_head=r"(?i)^\s*#*\s*(references|bibliography|.*\blicen[sc]e[d]?\b)",
    negation=("not", "no", "pas", "nicht", "non"),
    terms=(
        Term("t1", "MIT License", ("MIT Licence", "the MIT License"), severity="MINOR", priority=1),
        Term("t2", "GNU General Public License", ("General Public License", "GNU GPL"), severity="MAJOR", priority=1),
        Term("t3", "theration", ("thetion", "thering"), severity="MAJOR"),
        Term("t4", "inghered", ("ingthe", "ingand"), severity="MINOR"),
        Term("t5", "anderion", ("andtion",), type="deprecated", severity="MINOR", replaces="anderation"),
        Term("t6", "the order", type="ordering", order=("the", "and", "of", "in"), segment=r"\bthe\b[^.\n]{0,60}\bof\b", severity="MAJOR"),
    ),
    language=(
        Rule("double-mark", r"[!?]{2,}", "MINOR", message="repeated mark", replacement="!", advice="use one mark"),
        Rule("odd-suffix", r"(\w+)[$#%&*]{3}", "MAJOR", message="symbols after a word", replacement="$1", advice="drop the symbols"),
        Rule("pipe-list", r" \| ", "INFO", message="table residue", advice="write sentences", confidence=0.55),
    ),
    banned=(
        Rule("secret-token", r"token = \"[0-9a-f]{16,}\"", "FATAL", "political", "a secret stands in the text", advice="remove it"),
        Rule("mail", r"[\w.]+@[\w.]+\w", "MAJOR", "language", "a mail address", advice="remove it"),
        Rule("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "MAJOR", "language", "a network address", advice="remove it"),
    ),
    words={
        "universal": ("the", "and"), "conclusion": ("tion ", "ening "), "local": (" in ", " at "), "absolute": ("the", "was", "que"), "hard": ("was", "que"), "hedge": ("of", "and", "de"),
        "claim": ("with", "from"), "evidence": ("that",), "causal": ("for", "por", "par"), "vague": ("This", "That", "Which", "Those"), "noun": ("tion",), "opener": ("The ",), "europeanised": ("tion",), "lead": ("the",),
        "avoid": ("this", "which"), "comparison": ("year-on-year", "month-on-month", "that the"), "degree": ("strongly", "slightly", "of"),
    },
    repeats=(
        Rule("doubled-word", r"(?i)\b(\p{L}{2,})\s+\1\b", "MAJOR", message="doubled word", confidence=0.85),
        Rule("chain", r"(?:\bof\b[^,.;\n]{2,12}){3,}", "INFO", message="chain of attributes", confidence=0.85),
        Rule("doubled-ending", r"(?:tion){2,}", "MINOR", message="doubled ending", confidence=0.85),
        Rule("doubled-start", r"\b(?:the){2,}", "MAJOR", message="doubled article", confidence=0.85),
    ),
    quantifiers=(("with", 0.0, 50.0, "a majority is above half"), ("the", 50.0, 100.0, "state the share")),
    metrics=(("mean_sentence", 20.0, 60.0), ("symbol_density", 0.0, 0.02), ("lead_ratio", 0.2, 1.0)),
    cues=(r"\bthe (\w{6,})", r"\bof (\w{6,})", r"\band (\w{6,})"),
)

#: Words that count or measure, by what they measure; one of the large numbers may stand before them.
MEASURES = {
    "shares": ("%", "‰", "个百分点"),
    "things": ("个", "件", "台", "套", "条", "项", "座", "辆", "本", "份", "次"),
    "people": ("人", "人次", "名", "位", "户"),
    "money": ("元", "美元", "欧元", "日元"),
    "lengths": ("米", "千米", "厘米", "海里"),
    "areas": ("平方米", "平方千米", "亩"),
    "weights": ("克", "千克", "吨"),
    "volumes": ("升", "毫升", "立方米"),
    "times": ("秒", "分钟", "小时", "天", "周", "个月", "年"),
    "energy": ("度", "千瓦", "千瓦时", "焦耳"),
}
LARGE = ("万", "亿")


def measured(measures: dict[str, tuple[str, ...]] = MEASURES, large: tuple[str, ...] = LARGE) -> str:
    """A pattern of units: the longest word first, with or without a large number, or such a number alone."""
    words = sorted({w for group in measures.values() for w in group}, key=lambda w: (-len(w), w))
    many = "|".join(large)
    return f"(?:{many})?(?:{'|'.join(words)})|{many}"


ZH = Pack(
    name="zh",
    terminators="。！？；!?;\\n",
    closers="”’」』）)\"'",
    heading=r"^\s*(#{1,6}\s|第[一二三四五六七八九十百\d]+[章节部分]|[一二三四五六七八九十]+、)",
    reference_head=r"^\s*#*\s*(参考文献|引用文献)",
    negation=("不是", "并非", "不得", "没有", "未曾"),
    terms=(
        Term("z1", "数据集成", ("数椐集成", "数据集诚"), severity="MAJOR"),
        Term("z2", "次序", type="ordering", order=("春", "夏", "秋", "冬"), segment="[春夏秋冬、]{3,}"),
        Term("z3", "人工智能", ("人工智慧",), severity="MINOR"),
        Term("z4", "互联网", ("互连网", "因特网"), severity="MINOR"),
        Term("z5", "账号", ("帐号",), severity="MINOR"),
    ),
    language=(
        Rule("z-twice", r"(的)的", "MINOR", message="重复", replacement="$1"),
        Rule("z-spelling", "既使", "MAJOR", message="错别字", replacement="即使"),
        Rule("z-spelling-2", "做为", "MINOR", message="错别字", replacement="作为"),
        Rule("z-about", "大约[^，。；]{0,12}左右", "MINOR", message="约数重复", advice="去掉一个"),
    ),
    banned=(
        Rule("z-mail", r"[\w.]+@[\w.]+\w", "MAJOR", "language", "出现邮箱地址", advice="删去"),
        Rule("z-phone", r"\b1[3-9]\d{9}\b", "MAJOR", "language", "出现手机号码", advice="删去"),
    ),
    repeats=(
        Rule("z-mark-word", r"([的地得着过吧吗呢与及])\1", "MAJOR", message="虚词连用", confidence=0.85),
        Rule("z-same-word", r"([一-鿿]{3,8})\1", "MAJOR", message="词语连写两遍", confidence=0.85),
        Rule("z-attributes", "[一-鿿]{1,9}的[一-鿿]{1,9}的[一-鿿]{1,9}的", "INFO", message="一句三个定语", confidence=0.85),
    ),
    unit=measured(),
    words={
        "absolute": ("必然", "一定", "毫无疑问", "无一例外", "史无前例"), "hard": ("必然", "毫无疑问"), "hedge": ("可能", "或许", "似乎", "大概"), "evidence": ("数据", "%", "调查", "统计"), "claim": ("表明", "可见", "证明"),
        "causal": ("因此", "所以", "由此可见"), "vague": ("这些", "那些", "上述"), "universal": ("全国", "所有"), "conclusion": ("说明", "表明"), "local": ("本市", "本县", "本校"), "noun": ("部门",), "opener": (), "avoid": ("搞", "弄"),
        "europeanised": ("被", "对于"), "lead": ("一是", "二是", "首先"), "comparison": ("同比", "环比"), "degree": ("较快", "明显", "大幅", "略有", "稳定"),
    },
    quantifiers=(("大多数", 50.0, 100.0, "多数应过半"), ("少数", 0.0, 50.0, "少数应不足一半")),
    metrics=(("mean_sentence", 15.0, 50.0), ("symbol_density", 0.0, 0.03)),
    cues=(r"所谓“([^”]{2,12})”", r"([一-鿿]{2,8})（简称"),
)

#: English prose in general. LATIN is made to find something in invented prose, for queries and tests.
EN = Pack(
    name="en",
    terminators=".!?;\\n",
    closers="\"')\\]”’",
    heading=r"^\s*(#{1,6}\s|\p{Lu}[^.!?]*$)",
    reference_head=r"(?i)^\s*#*\s*(references|bibliography|works cited|sources)\s*$",
    negation=("not", "no", "never", "without", "hardly"),
    terms=(
        Term("e1", "open source", ("opensource",), severity="MINOR"),
        Term("e2", "website", ("web-cite", "websight"), severity="MINOR"),
        Term("e3", "machine learning", ("machine learing", "maschine learning"), severity="MAJOR"),
        Term("e4", "seasons", type="ordering", order=("spring", "summer", "autumn", "winter"), segment=r"(?:\b(?:spring|summer|autumn|winter)\b(?:, and |, | and )?){2,}"),
        Term("e5", "fax machine", ("telefax apparatus",), type="deprecated", severity="INFO", replaces="scanner"),
    ),
    language=(
        Rule("double-mark", r"[!?]{2,}", "MINOR", message="repeated mark", replacement="!", advice="use one mark"),
        Rule("could-of", r"\b(could|should|would) of\b", "MAJOR", message="of instead of have", replacement="$1 have"),
        Rule("alot", r"\balot\b", "MINOR", message="two words", replacement="a lot"),
        Rule("receive", r"\b([Rr])ecieve", "MINOR", message="spelling", replacement="$1eceive"),
        Rule("separate", r"\b([Ss])eperat", "MINOR", message="spelling", replacement="$1eparat"),
        Rule("reason-because", r"\breason\b[^.]{0,40}\bis because\b", "INFO", message="says the reason twice", advice="write 'is that'", confidence=0.6),
    ),
    banned=(
        Rule("mail", r"[\w.+-]+@[\w-]+\.[\w.]+\w", "MAJOR", "language", "a mail address", advice="remove it"),
        Rule("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "MAJOR", "language", "a network address", advice="remove it"),
        Rule("secret", r"(?i)\b(?:password|api[_ ]?key|token)\s*[:=]\s*\S{8,}", "FATAL", "political", "a secret stands in the text", advice="remove it"),
    ),
    words={
        "universal": ("all ", "every ", "everyone", "nobody"), "conclusion": ("shows that", "proves that", "means that"), "local": ("in our town", "at our site", "in this school"),
        "absolute": ("always", "never", "undoubtedly", "certainly", "without exception"), "hard": ("undoubtedly", "without exception"), "hedge": ("perhaps", "may ", "might", "possibly", "seems"),
        "claim": ("we argue", "it is clear", "this proves"), "evidence": ("%", "per cent", "survey", "figures", "measured", "according to"), "causal": ("therefore", "hence", "consequently"),
        "vague": ("This ", "That ", "These ", "Those "), "noun": ("study", "report", "method", "result", "committee"), "opener": ("There is ", "There are ", "It is "), "europeanised": ("in order to", "with regard to", "the fact that"),
        "lead": ("First", "Second", "Finally", "In short"), "avoid": ("utilize", "leverage", "going forward", "synergy"), "comparison": ("year-on-year", "year on year", "month-on-month"), "degree": ("strongly", "slightly", "markedly", "considerably"),
    },
    repeats=(
        Rule("doubled-word", r"(?i)\b(\p{L}{2,})\s+\1\b", "MAJOR", message="doubled word", confidence=0.85),
        Rule("chain", r"(?:\bof\b[^,.;\n]{2,20}){4,}", "INFO", message="chain of attributes", confidence=0.85),
    ),
    quantifiers=(("the majority", 50.0, 100.0, "a majority is above half"), ("a minority", 0.0, 50.0, "a minority is below half"), ("nearly all", 85.0, 100.0, "state the share")),
    metrics=(("mean_sentence", 40.0, 160.0), ("symbol_density", 0.0, 0.02)),
    cues=(r"\b(?:so-called|known as|termed) “([^”]{3,40})”", r"\bthe term “([^”]{3,40})”"),
)

PACKS = {p.name: p for p in (EN, LATIN, ZH)}


def pattern_rows(pack: Pack) -> list[dict]:
    """A row for each pattern, the highest priority winning: pattern, role (variant or standard), and the term's columns."""
    best: dict[str, dict] = {}
    for t in pack.terms:
        for role, patterns in (("standard", (t.term,)), ("variant", t.variants)):
            for p in patterns:
                row = {"pattern": p, "role": role, "term_id": t.id, "term": t.term, "type": t.type, "severity": t.severity, "suggestion": t.replaces or t.term, "source": t.source, "priority": t.priority, "confidence": t.confidence, "explain": t.explain}
                if p and (p not in best or t.priority > best[p]["priority"]):
                    best[p] = row
    return [best[p] for p in sorted(best)]


def term_rows(spark: SparkSession, pack: Pack) -> DataFrame:
    """pattern_rows as a table."""
    kinds = "pattern string, role string, term_id string, term string, type string, severity string, suggestion string, source string, priority int"
    names = [k.split()[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in pattern_rows(pack)], kinds)
