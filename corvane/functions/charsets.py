"""Which character set bytes are written in.

A byte order mark, strict UTF-8 and the zero bytes of UTF-16 decide where they can. Else every set that decodes the bytes is
scored: the pairs of neighbouring bytes of which one is no ASCII are counted once, and the counts are multiplied with
a table of log probabilities for each set and language. The tables are made from short texts of frequent words,
so a set is told by the spelling of a language it is used for, not by rules of its own.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np

#: Frequent words by language.
TEXTS = {
    "french": "café été déjà à où ça même être après très élève français élevé procédé qualité société année première système général © 2020 ® € 100 “ ” ‘ ’ l’ d’ – — … ° « » père mère frère règle dernière manière près dès succès accès problème siècle tôt tête fête forêt côté bientôt hôtel plutôt là voilà modèle développement créé idées l'été s'être naïve noël œuvre reçu garçon leçon août île connaît apparaît événement sécurité activité région département réponse mémoire étude école étudiant également élément évaluer préparer dépôt vêtement fenêtre enquête arrêt prêt",
    "german": "für über können müssen größe straße schön natürlich gehört später wäre würde möglich früher jährlich während müssten größer großen weiß daß heißt außer fuß schließen läßt ähnlich änderung öffnen übung über überall zurück stück glück mädchen männer häuser wälder länder völker hören böse löst könig fünf grün kühl süß zwölf öl äpfel ärger prüfung gefühl gespräch geschäft erklären verhältnis bevölkerung dafür darüber gegenüber österreich münchen köln",
    "spanish": "señor mañana español niño también más está así según después país información educación número público él aún años año compañía pequeño españa día días vía había tenía podría sería todavía política música técnica análisis economía crédito médico último único jóvenes situación relación población acción nación producción atención opinión cuestión región razón corazón avión ¿qué? ¿cómo? ¡sí! además través interés inglés francés detrás jamás quizás",
    "portuguese": "não são ção informação também português à será então até você país coração educação população situação nação ações eleições três mês inglês público político econômico histórico início próximo último família história área água memória necessário operação função açúcar cabeça força começo preço irmã mãe mão pão lições milhões perché più già così può è università qualità verità città società però libertà attività cioè né sarà",
    "nordic": "på är och att från även många där över får två år både året også være større først når går høre blå språk för genom själv någon människor världen första måste åren någre både måned dør grønn øke sør nåværende måde må skånsk läsa skriva känna så gärna säga stå gå få små också mängd ökning åtgärd språket området hög låg väg väl",
    "central": "że się nie jest są także może które został był mówi będzie żeby więc ją dzięki książka świat życie człowiek został pieniądze źródło łatwo że při což který může jeho také jsou však společnost příliš žluťoučký kůň úpěl ďábelské ódy možnost člověk světa dětí více hogy nem és egy csak mint még már vagy között első különböző őket szükség lehetőség magyarország később években többi fő kérdés človek môže ktorý",
    "russian": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой так же от сказать для год мочь ты человек о один такой тот время если когда день жизнь рука первый очень только его как было все были может после можно есть работа слово место вопрос дело стороны страны лицо друг глаз теперь ничего больше между должен самый России Москва город история развитие система общество государство программа документ данные товар цена количество улица магазин стол стул книга",
    "greek": "και το να του η της με που την από για είναι στο τον οι θα δεν τα σε ότι μου αυτό τη στην ένα μια ο κι αν όπως έχει πολύ κάθε μόνο όλα πρώτη χρόνια άνθρωπος ελλάδα μεγάλη σήμερα πρέπει υπάρχει μπορεί ημέρα κόσμος χώρα τιμή προϊόν πόλη οδός βιβλίο",
    "hebrew": "של את על לא הוא זה עם כי היא גם אני או היה יש אל כל אבל אם רק כך בין אחד יותר מה לי הם אחרי עוד היום זמן דבר בית אדם עיר שנה מדינה ישראל עבודה מחיר מוצר רחוב ספר שולחן",
    "arabic": "في من على أن إلى التي عن لا ما هذا هذه كان مع ذلك الذي بين كل قد بعد عند أو لم كما حيث أكثر يكون هو هي إن وقد غير العام العربية المدينة الناس اليوم السنة العمل الحكومة الدولة الكتاب السعر المنتج الكمية الشارع القاهرة بيت ولد كبير صغير جديد أول المنطقة العالم خلال حتى",
    "turkish": "bir ve bu için çok daha ile değil olarak gibi kadar sonra şey büyük gün yıl olduğu içinde şimdi ancak önce türkiye başka güzel kişi çocuk iş yeni göre dünya müşteri ürün şehir sokak öğrenci ağaç ışık kız sınıf yanlış doğru çalışma ığdır",
    "thai": "ที่ และ ใน การ เป็น ของ มี ได้ ไม่ ให้ จะ ว่า ไป มา กับ คน นี้ ความ แต่ อยู่ จาก โดย หรือ วัน ปี ประเทศ ไทย เมือง ราคา สินค้า หนังสือ ถนน บ้าน งาน ทำ รู้ เรา เขา",
    "japanese": "の は に を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる について 日本 東京 年 月 日 人 会社 時間 商品 価格 数量 都市 名前 本 店 学校 問題 カタカナ テスト データ ー ン ス ト ル ア イ リ ク ラ コ",
    "chinese": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之 年 过 发 后 作 里 用 道 行 所 然 家 种 事 成 方 多 经 么 去 法 学 如 都 同 现 当 没 动 面 起 看 定 天 分 还 进 好 小 部 其 些 主 样 理 心 本 前 开 但 因 只 从 想 实 日 中国 我们 城市 价格 商品 数量 名称 北京 上海",
    "traditional": "的 一 是 不 了 在 人 有 我 他 這 個 們 中 來 上 大 為 和 國 地 到 以 說 時 要 就 出 會 可 也 你 對 生 能 而 子 那 得 於 著 下 自 之 年 過 發 後 作 裡 用 道 行 所 然 家 種 事 成 方 多 經 麼 去 法 學 如 都 同 現 當 沒 動 面 起 看 定 天 分 還 進 好 小 部 其 些 主 樣 理 心 本 前 開 但 因 只 從 想 實 日 臺灣 我們 城市 價格 商品 數量 名稱 臺北",
    "korean": "이 그 것 수 있다 하다 는 을 를 의 에 가 은 도 로 고 한 다 지 에서 으로 하는 있는 대한 그리고 사람 우리 나라 한국 서울 시간 년 월 일 말 때 문제 가격 상품 수량 도시 이름 책 가게 학교 회사 정부 사회 자신 하지만 그러나 때문에 위해 않다 없다 같다 되다 보다 오다 가다 주다 알다 입니다 합니다 습니다 했다 것이다",
}
TEXTS["western"] = " ".join(TEXTS[x] for x in ("french", "german", "spanish", "portuguese", "nordic"))
#: Character sets in the order in which ties are settled, each with its languages and how much less usual it is than the first (log).
CHARSETS = [
    ("windows-1252", "western french german spanish portuguese nordic", 0), ("windows-1251", "russian", 3), ("shift_jis", "japanese", 4), ("gb18030", "chinese", 4), ("windows-1250", "central", 6), ("iso-8859-2", "central", 7), ("euc-kr", "korean", 4), ("big5", "traditional", 4), ("euc-jp", "japanese", 4),
    ("windows-1256", "arabic", 4), ("koi8-r", "russian", 4), ("windows-1253", "greek", 4), ("windows-1254", "turkish", 5), ("windows-1255", "hebrew", 4), ("tis-620", "thai", 4), ("cp866", "russian", 5), ("iso-8859-5", "russian", 5), ("iso-8859-6", "arabic", 6),
]
CANDIDATES = [(charset, language, rare) for charset, languages, rare in CHARSETS for language in languages.split()]
#: What Python calls a set if not as above: the codec that knows most of its characters.
CODECS = {"shift_jis": "cp932", "euc-kr": "cp949", "tis-620": "cp874"}
MULTI_BYTE = {"shift_jis", "gb18030", "euc-kr", "big5", "euc-jp", "iso-2022-jp"}
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
#: Shares of pairs, of bytes by themselves, and of anything in a model.
PAIRS, BYTES, ANY = 0.6, 0.39, 0.01
#: How usual words in small letters, with a capital and in capitals are.
FORMS = (0.8, 0.1, 0.1)
HALF_WIDTH, BEYOND_ASCII, MOST_HALF_WIDTH = re.compile("[\uff61-\uff9f]"), re.compile("[^\x00-\x7f]"), 0.3
#: Minus the log probability of a pair in bytes that are no text of any of these sets.
NONSENSE = 11.5


def codec(charset: str) -> str:
    return CODECS.get(charset, charset)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Bytes as symbols: of ASCII, letters, digits, white space and others are one symbol each."""
    out = np.arange(256)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4
    return out


def pair_counts(data: bytes) -> np.ndarray:
    """How often each pair of neighbouring symbols occurs of which one is no ASCII; white space is at both ends."""
    x = _kinds()[np.frombuffer(b" " + data + b" ", np.uint8)]
    first, second = x[:-1], x[1:]
    high = (first >= 128) | (second >= 128)
    return np.bincount(first[high] * 256 + second[high], minlength=1 << 16)


@lru_cache(1)
def models() -> np.ndarray:
    """Log probabilities of pairs, a row for each set and language of CHARSETS."""
    rows = []
    for charset, language, _ in CANDIDATES:
        said = [TEXTS[language], TEXTS[language].title(), TEXTS[language].upper()]
        counts = sum(share * pair_counts(t.encode(codec(charset), "ignore")) for share, t in zip(FORMS, said, strict=True)).reshape(256, 256)
        first, second = counts.sum(1), counts.sum(0)
        n = counts.sum()
        spread = (np.arange(256) >= 128)[:, None] | (np.arange(256) >= 128)[None, :]
        rows.append(np.log(PAIRS * counts / n + BYTES * np.outer(first / n, second / n) + ANY * spread / spread.sum() + 1e-12).ravel())
    return np.array(rows, np.float32)


def decodes(data: bytes, charset: str, cut: bool) -> bool:
    """Whether the bytes are a text of the set, whose last character may be incomplete if they were cut.

    Almost any bytes can be half-width katakana: of those, Japanese text has few.
    """
    try:
        text = codecs.getincrementaldecoder(codec(charset))("strict").decode(data, final=not cut)
    except UnicodeDecodeError:
        return False
    return charset != "shift_jis" or len(HALF_WIDTH.findall(text)) <= MOST_HALF_WIDTH * len(BEYOND_ASCII.findall(text))


def _without_mark(data: bytes) -> str | None:
    """UTF-16 without a byte order mark: every other byte of its ASCII characters is zero."""
    half = len(data) // 2
    if half >= 2:
        zeros = [data[i : 2 * half : 2].count(0) for i in (0, 1)]
        for side, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if zeros[side] > 0.3 * half and zeros[1 - side] < 0.05 * half:
                return name
    return None


def detect(data: bytes, cut: bool = False) -> str:
    """The name of the character set of the bytes; `cut`: they are the beginning of something longer. What nothing decodes is utf-8, with replacements."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if b"\x1b$" in data and decodes(data, "iso-2022-jp", cut):
        return "iso-2022-jp"
    wide = _without_mark(data)
    if wide is not None:
        return wide
    if decodes(data, "utf-8", cut):
        return "utf-8"
    counts = pair_counts(data)
    seen = np.flatnonzero(counts)
    scores = models()[:, seen] @ counts[seen].astype(np.float32)
    found = [(score - rare, -k, name) for k, ((name, _, rare), score) in enumerate(zip(CANDIDATES, scores.tolist(), strict=True)) if decodes(data, name, cut)]
    nonsense = -float(counts.sum()) * NONSENSE
    return max([*found, (nonsense, 1, "utf-8")])[2]


def decode(data: bytes, charset: str | None = None) -> str:
    """The text of whole bytes, by their own character set unless it is given; a byte order mark is no part of it."""
    charset = charset or detect(data)
    return data.decode("utf-8-sig" if charset == "utf-8" else codec(charset), "replace")
