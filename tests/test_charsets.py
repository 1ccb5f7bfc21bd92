"""Character sets: texts that are not those of the models, encoded in every set, and tables in such sets."""

import random

import pytest

from corvane.functions import charsets
from corvane.sources import files

OLD_MAN = {
    "russian": "Старик проснулся рано утром, взял удочку и пошел к реке ловить рыбу вместе с внуком. Погода стояла прекрасная, над водой поднимался туман, и вдалеке слышался колокольный звон. Они молча сидели на берегу и смотрели на поплавки",
    "arabic": "استيقظ الرجل مبكرا وذهب إلى السوق لشراء الخبز والحليب ثم عاد إلى منزله وقرأ الجريدة. كانت السماء صافية والطيور تغرد فوق الأشجار بينما جلس الأطفال أمام البيت يلعبون",
    "japanese": "昔々あるところにおじいさんとおばあさんが住んでいました。 おじいさんは山へ柴刈りに行きました。 おばあさんは川へ洗濯に行きました。 すると川上から大きな桃が流れてきました。 おばあさんはそれを拾って家に持って帰りました。",
    "chinese": "从前有一个老人住在山脚下， 他每天早上都要到河边去打水， 然后回家给孙子做早饭。 有一天他在路上看见一只受伤的小鸟， 就把它带回家里照顾。",
    "traditional": "從前有一個老人住在山腳下， 他每天早上都要到河邊去打水， 然後回家給孫子做早飯。 有一天他在路上看見一隻受傷的小鳥， 就把它帶回家裡照顧。",
    "korean": "옛날 옛적에 어느 마을에 할아버지와 할머니가 살고 있었습니다. 할아버지는 산으로 나무를 하러 가고 할머니는 강으로 빨래를 하러 갔습니다. 그러던 어느 날 큰 복숭아가 떠내려 왔습니다.",
    "western": "Le vieil homme s'est levé très tôt, a pris sa canne à pêche et s'est dirigé vers la rivière. Il y avait là une barque où son frère aîné rêvait déjà. Der alte Mann hörte die Vögel über den Bäumen, während früh am Morgen die Glocken läuteten",
    "central": "Stary człowiek wstał wcześnie rano, wziął wędkę i poszedł nad rzekę łowić ryby z wnukiem. Nad wodą unosiła się mgła, a w oddali słychać było dzwony kościoła. Siedzieli milcząc na brzegu i patrzyli na spławiki",
    "greek": "Ο γέρος ξύπνησε νωρίς το πρωί, πήρε το καλάμι του και πήγε στο ποτάμι για ψάρεμα μαζί με τον εγγονό του. Ο ουρανός ήταν καθαρός και τα πουλιά τραγουδούσαν",
    "turkish": "Yaşlı adam sabah erkenden kalktı, oltasını aldı ve torunuyla balık tutmaya ırmağa gitti. Gökyüzü açıktı, ağaçların üzerinde kuşlar ötüyor, çocuklar evin önünde oynuyordu",
    "hebrew": "הזקן קם מוקדם בבוקר לקח את החכה שלו והלך אל הנהר לדוג דגים יחד עם הנכד השמיים היו בהירים והציפורים שרו מעל העצים",
    "thai": "ชายชราตื่นแต่เช้าตรู่ หยิบเบ็ดตกปลาแล้วเดินไปที่แม่น้ำกับหลานชาย ท้องฟ้าแจ่มใส นกร้องเพลงอยู่บนต้นไม้",
}


def generated(language, seed):
    rng = random.Random(seed)
    words = OLD_MAN[language].split(" ")
    return " ".join(rng.choices(words, k=40 if len(OLD_MAN[language]) > 4 * len(words) else 60))


@pytest.mark.parametrize("charset,languages,rare", charsets.CHARSETS)
def test_generated_files_decode_right(charset, languages, rare):
    language = languages.split()[0]
    right = 0
    for seed in range(100):
        text = generated(language, seed)
        data = text.encode(charsets.codec(charset), "ignore")
        right += charsets.decode(data) == data.decode(charsets.codec(charset))
    assert right >= 95


def test_marks_utf_and_nonsense():
    assert [charsets.detect("né".encode(e)) for e in ("utf-8", "utf-8-sig", "utf-16", "utf-32")] == ["utf-8", "utf-8", "utf-16", "utf-32"]
    assert [charsets.detect("hello né".encode(e)) for e in ("utf-16-le", "utf-16-be", "iso-2022-jp")[:2]] == ["utf-16-le", "utf-16-be"]
    assert charsets.detect("日本語".encode("iso-2022-jp")) == "iso-2022-jp"
    assert charsets.detect("日本"[:2].encode()[:-1], cut=True) == "utf-8" and charsets.detect(b"") == "utf-8"
    assert charsets.decode(b"\x81\xff\xff\x81") == "\ufffd" * 4


@pytest.mark.parametrize("charset,language", [("windows-1256", "arabic"), ("koi8-r", "russian"), ("shift_jis", "japanese"), ("gb18030", "chinese"), ("windows-1252", "western"), ("windows-1250", "central")])
def test_tables_in_other_sets_are_read(spark, tmp_path, charset, language):
    words = [w.strip('.,"，。') for w in OLD_MAN[language].split(" ")]
    body = f"{words[0]};n\n" + "".join(f'"{w}";{i}\n' for i, w in enumerate(words))
    path = tmp_path / "t.csv"
    path.write_bytes(body.encode(charsets.codec(charset)))
    got = files.read_csv(spark, str(path))
    assert got.columns == [words[0], "n"] and dict(got.dtypes)["n"] == "int"
    assert [r[0] for r in got.orderBy("n").collect()] == words
    texts = {r.filename: r.text for r in files.read_texts(spark, str(path)).collect()}
    assert texts == {"t.csv": body}


def test_evidence_is_found_behind_the_first_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"name;n\n" + b"plain;1\n" * 500 + "élève très;2\n".encode("cp1252"))
    got = files.read_csv(spark, str(path))
    assert {r["name"] for r in got.collect()} == {"plain", "élève très"}


def test_files_without_quoted_breaks_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a, b",1\n')
    (tmp_path / "b.csv").write_text('x,y\n"a\nb",1\n')
    assert not files.has_quoted_breaks(spark, str(tmp_path / "a.csv")) and files.has_quoted_breaks(spark, str(tmp_path / "b.csv"))
    assert [files.read_csv(spark, str(tmp_path / f"{x}.csv")).first()["x"] for x in "ab"] == ["a, b", "a\nb"]
