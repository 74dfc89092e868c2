import pytest

from quillspark.llm import encoding as E

CLEAN = ["Die Leitlinie empfiehlt für ältere Menschen größere Vorsicht – überall.", "L’étude a été menée auprès des opérés à Paris.", "La función está garantizada para los años.", "Пациенты должны получать оценку риска после операции.", "O diâmetro não é estável; REPARAÇÃO E DILATAÇÃO.", "The operator’s value of 6–12 µmol/l and 5 kg/m² or ≥ 3°."]
DF = "record_key string, text string"


def garble(text, encoding, times=1):
    for _ in range(times):
        table = E.BYTES[E.ENCODINGS.index(encoding)]
        char = {int(b): chr(c) for c, b in enumerate(table) if b != E.NONE and (c < 0x80) == (b < 0x80)}
        text = "".join(char.get(b, chr(b)) for b in text.encode())
    return text


def frame(spark, rows):
    return spark.createDataFrame(rows, DF)


@pytest.mark.parametrize("encoding", E.ENCODINGS)
def test_round_trip(spark, encoding):
    rows = [(f"clean{i}", CLEAN[i % 6] + f" Nr. {i}.") for i in range(120)]
    bad = [(f"bad{i}", garble(x, encoding)) for i, x in enumerate(CLEAN)]
    got = {r.record_key: r.restored for r in E.garbled_texts(frame(spark, rows + bad), ["record_key"]).collect()}
    assert got == {f"bad{i}": x for i, x in enumerate(CLEAN)}


def test_partly_twice_and_lost(spark):
    rows = [(f"clean{i}", CLEAN[i % 6] + " La qualità dei dati.") for i in range(120)]
    partly = CLEAN[0] + " " + garble("für Männer", "cp1252") + " " + CLEAN[1]
    rows += [("partly", partly), ("twice", garble("l’été dernier", "cp1252", 2)), ("lost", "M�rault"), ("plain blank", "della qualitÃ  dei dati"), ("none", None), ("empty", ""), ("twice", garble("l’été dernier", "cp1252", 2))]
    found = E.garbled_texts(frame(spark, rows), ["record_key"]).collect()
    got = {r.record_key: r.restored for r in found}
    assert got == {"partly": CLEAN[0] + " für Männer " + CLEAN[1], "twice": "l’été dernier", "lost": "M�rault", "plain blank": "della qualità dei dati"}
    assert len(found) == 5


def test_look_alikes_and_capitals_are_clean(spark):
    rows = [(f"clean{i}", CLEAN[i % 6]) for i in range(60)] + [("a", "surgісаl соnsultаtіon"), ("b", "NÃO EXCLUEM A REPARAÇÃO"), ("c", "ＧＲＯＷＴＨ"), ("d", "喫煙者は経過観察を続ける。"), ("e", "a  b — “c”…")]
    assert E.garbled_texts(frame(spark, rows), ["record_key"]).count() == 0


def test_restored_table_and_empty(spark):
    rows = [(f"clean{i}", CLEAN[i % 6]) for i in range(60)] + [("bad", garble(CLEAN[0], "cp1252"))]
    got = {r.record_key: r.text for r in E.restored_texts(frame(spark, rows), "record_key").collect()}
    assert len(got) == 61 and got["bad"] == CLEAN[0]
    assert E.garbled_texts(frame(spark, []), ["record_key"]).count() == 0


def test_very_long(spark):
    long = CLEAN[3] * 3000
    rows = [(f"clean{i}", CLEAN[i % 6]) for i in range(60)] + [("long", garble(long, "cp1251"))]
    assert [r.restored for r in E.garbled_texts(frame(spark, rows), ["record_key"]).collect()] == [long]


@pytest.mark.parametrize("true, read, word", [("latin-1", "mac_roman", "La ecografía confirmée des données"), ("cp1252", "cp437", "A evidência também préopératoire"), ("cp1251", "cp1252", "Пожилые люди")])
def test_single_byte_text_read_in_another_encoding(spark, true, read, word):
    rows = [(f"clean{i}", CLEAN[i % 6] + " La ecografía confirmée des données; a evidência também é préopératoire. Пожилые люди.") for i in range(120)]
    bad = word.encode(true).decode(read)
    got = {r.record_key: r.restored for r in E.garbled_texts(frame(spark, rows + [("bad", bad)]), ["record_key"]).collect()}
    assert got == {"bad": word}


def test_one_wrong_letter_alone(spark):
    rows = [(f"clean{i}", CLEAN[i % 6] + " O tambores da pressão; una ecografía, la réponse. È vero, ΔP e Ω.") for i in range(120)]
    rows += [("a", "A pressπo arterial"), ("b", "una ecografÌa normal"), ("c", "la rÈponse")]
    got = {r.record_key: r.restored for r in E.garbled_texts(frame(spark, rows), ["record_key"]).collect()}
    assert got == {"a": "A pressão arterial", "b": "una ecografía normal", "c": "la réponse"}
