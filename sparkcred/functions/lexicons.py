"""Word lists, lookup tables, patterns and limits that results depend on."""

from __future__ import annotations

# ---- Fixed values ---------------------------------------------------------------------------------------

#: Flags in order, and the keywords matched in cleaned text ("100%" can never match there).
FLAGS = ("stat_distortion", "causal_error", "emotional_provocation", "source_lack", "img_mismatch")
ETL_LEXICON = {
    "stat_distortion": ("100%", "모든", "항상", "절대", "never", "always"),
    "causal_error": ("때문에", "원인", "증명", "결과적으로", "causes", "proves"),
    "emotional_provocation": ("충격", "경악", "분노", "shocking", "outrage", "unbelievable"),
    "source_lack": ("관계자", "소식통", "익명", "sources say", "reportedly"),
    "img_mismatch": ("사진 속", "이 사진은", "photo shows", "pictured here"),
}
#: Keywords matched in the raw content of fact checks, with case.
FACTCHECK_LEXICON = {
    "stat_distortion": ("100%", "모든", "항상", "절대", "never", "always"),
    "causal_error": ("때문에", "원인", "증명", "결과적으로", "causes", "proves"),
    "emotional_provocation": ("충격", "경악", "분노", "shocking", "outrage"),
    "source_lack": ("관계자", "소식통", "익명", "sources say", "reportedly"),
    "img_mismatch": ("사진 속", "이 사진은", "photo shows"),
}
#: Phrases matched in the raw title and body of live articles, with case.
LIVE_LEXICON = {
    "stat_distortion": ("100% 효과", "100% 안전", "100% 확실", "100% 증명", "단 한 명도", "예외 없이", "전원 사망", "전원 감염", "완전히 사라졌다", "완전 치료", "기적의 치료", "완벽하게 차단", "100% 예방", "100% effective", "100% proven", "without exception", "100% safe", "guaranteed results", "zero exceptions"),
    "causal_error": ("이것이 원인", "직접적인 원인은", "유일한 원인", "먹으면 낫는다", "하면 무조건 낫는", "이것만 먹으면", "기적의 식품", "기적의 약", "만병통치", "의학적으로 증명됐다", "과학적으로 완전히 증명", "directly causes", "proven to cure", "miracle cure", "this one trick", "doctors hate", "guaranteed to work"),
    "emotional_provocation": ("충격 고백", "충격 폭로", "충격적인 진실", "충격 반전", "경악스러운", "경악을 금치 못", "분노 폭발", "공분을 사", "국민적 공분", "당신만 모르는", "이것을 숨겼다", "쉬쉬하던", "절대 알려주지 않는", "믿기지 않는 사실", "상상도 못한 진실", "충격! 충격", "경고!!!", "shocking truth", "they don't want you to know", "what they hide", "wake up sheeple", "exposed!!!"),
    "source_lack": ("소식통에 따르면", "익명의 관계자", "익명을 요구한", "카더라", "~라는 말이 있다", "알 수 없는 소식통", "정체불명의", "확인되지 않은 보도", "출처 불명", "누군가에 따르면", "업계 일각에서는 주장", "anonymous sources claim", "sources say without evidence", "unconfirmed reports", "rumor has it"),
    "img_mismatch": ("사진 속 인물은", "이 사진은 실제로", "조작된 사진", "합성 사진", "가짜 사진", "이미지를 도용", "실제 사진이 아닌", "다른 나라 사진을", "오래된 사진을 사용", "사진이 조작됐다", "이미지 합성", "photo is fake", "image was manipulated", "old photo used as", "photo from different", "doctored image"),
}
#: Verdict keywords in the order they are tried, with their label.
VERDICTS = (
    ("전혀 사실 아님", 1), ("대체로 사실 아님", 1), ("사실 아님", 1), ("사실이 아닙", 1), ("사실과 다릅", 1), ("사실과 달리", 1),
    ("근거가 없", 1), ("근거 없음", 1), ("근거없음", 1), ("확인되지 않", 1), ("확인할 수 없", 1), ("과장됐", 1), ("과장되었", 1),
    ("왜곡됐", 1), ("왜곡되었", 1), ("틀렸", 1), ("맞지 않", 1), ("거짓", 1), ("오해", 1), ("왜곡", 1), ("false", 1),
    ("mostly false", 1), ("pants on fire", 1), ("대체로 사실", 0), ("절반의 사실", 0), ("사실입니다", 0), ("사실로 확인", 0),
    ("사실이 맞", 0), ("확인됐습니다", 0), ("확인되었습니다", 0), ("맞습니다", 0), ("사실", 0), ("true", 0), ("mostly true", 0), ("half true", 0),
)
VERDICT_PATTERN = r"판정\s*[:：]\s*([^\n\r]{2,20})"
#: Boilerplate patterns, matched without case.
BOILERPLATE = (
    r"무단\s*전재.{0,20}금지",
    r"저작권.{0,20}무단.{0,20}금지",
    r"copyright\s*©?\s*\d{4}.{0,30}all rights reserved",
    r"all rights reserved\.?\s*$",
    r"\(c\)\s*\d{4}\s+\w[\w\s]+\.",
)
#: Characters that are not special.
STANDARD_CHARS = r"""가-힣a-zA-Z0-9\s.,!?;:'"()\[\]{}\-/\\@#%&*+=<>|~`^_"""
#: Limits of the quality filters.
MIN_CONTENT, LEAST_CONTENT, MAX_CONTENT, SPECIAL_MAX, BOILERPLATE_REST, FOREIGN_MAX, TITLE_SIMILARITY = 20, 150, 10_000, 0.35, 50, 0.10, 0.90
#: Media names of the English part of the corpus.
ENGLISH_MEDIA = ("politicsNews", "worldnews", "News", "Unknown", "politics", "US_News", "left-news", "Government News")
#: Words counted in titles for the meta features.
EMOTION_PATTERN = "결국|충격|경악|속보|단독|논란|분노|의혹|발각|공개|주의|확인"
#: Stop words of the Korean features, and those the serving tokenizer adds.
STOPWORDS = (
    "하다", "있다", "되다", "돼다", "이다", "않다", "없다", "받다", "늘다", "따르다", "오다", "가다", "보다", "같다", "아니다", "그렇다",
    "이렇다", "어떻다", "나오다", "보이다", "들다", "내다", "맞다", "시키다", "만들다", "대다", "이르다", "나타나다", "밝히다", "말하다",
    "위해", "통해", "대한", "대해", "때문", "함께", "한편", "가운데", "지난", "이번", "현재", "최근", "특히", "모든", "모두", "다른",
    "이상", "이후", "부터", "다양하다", "높다", "가능하다", "필요하다", "가장", "이렇게", "라며", "우리", "자신",
)
SERVING_STOPWORDS = ("기자", "뉴스", "보도", "그리고", "그래서")
#: Weights of the soft vote, and score thresholds of the sweeps.
VOTE_WEIGHTS = {"logistic": 0.7105, "nbsvm": 0.7301, "nb": 0.6273}
KOREAN_SHARE, PAGE_SIZE, TTL_SECONDS = 0.15, 30, 300
#: CSS selectors of article bodies in the order they are tried, and of nodes dropped from them.
BODY_SELECTORS = ("#dic_area", "._article_body_contents", "#articleBodyContents", ".go_trans._article_content", ".article_body")
BODY_DROPS = ("script", "style", ".reporter_area", ".copyright", ".article-sns-group")
LIST_CLASSES = ("type06_headline", "type06", "type02")
UNKNOWN_PRESS = "알 수 없음"

#: Short names of the weekdays from Monday on, and listing pages read by kind of view.
WEEKDAYS = ("월", "화", "수", "목", "금", "토", "일")
PAGE_DEPTH = {"crawl": 20, "main": 8, "section": 2}
