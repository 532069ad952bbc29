import os
from pathlib import Path

import numpy as np
import pytest
from conftest import rows

from chatlake.llm import spam

SHEET = "The gardener asked why the footer is partial, because the old copy was incomplete. Instead of a colourful counter, try a partial archive about daylight saving. It took 56 hours to merge the appendix in the shared folder, so that nothing gets lost. "
LINKS = " ".join(f'<a href="https://quilldesk.example/invoice/{i}">cheap flights</a>' for i in range(20))
UNRELATED = "lamp carpet drill printer sofa kettle bicycle tent charger mattress jacket blender helmet camera backpack monitor scarf toaster wallet guitar perfume vacuum keyboard sandals curtain fridge heater stapler umbrella goggles ladder thermos suitcase"
#: Prose written for this test; no table and no training text holds it.
PROSE = {
    "en": "The ferry left late that evening, and by the time we reached the island the harbour lights were already out. My aunt was waiting on the pier with a lantern and a thermos of soup. She said nothing about the delay; she only asked whether we had remembered the seeds, because the ground would soon be too hard to dig.",
    "en2": "Water boils at a lower temperature on a mountain because the air presses on it less. That is why pasta takes longer to cook in the Alps than at the seaside, and why tea there tastes a little flat to people who come up from the valley.",
    "de": "Als der Regen endlich aufhörte, öffnete die alte Frau das Fenster und hörte den Spatzen zu. Ihr Enkel hatte versprochen, am Nachmittag zu kommen, aber der Zug aus Leipzig war wie immer verspätet. Sie setzte Wasser auf, stellte zwei Tassen hin und dachte an den Sommer, in dem sie zum ersten Mal das Meer gesehen hatte.",
    "fr": "Le boulanger du village se lève chaque nuit à trois heures pour allumer son four. Quand les premiers clients arrivent, le pain est encore chaud et toute la rue sent la farine grillée. Il dit souvent que son métier lui a appris la patience, car la pâte ne se presse jamais et l'on ne peut rien y changer.",
    "es": "Mi abuelo guardaba en el desván una caja llena de mapas antiguos. Los domingos, después de comer, extendía uno sobre la mesa y nos contaba por dónde había viajado cuando era joven. Nunca supimos cuánto había de verdad en aquellas historias, pero ninguno de nosotros quería que terminaran.",
    "it": "La biblioteca chiude alle sei, ma il custode lascia sempre la porta aperta per chi deve finire una pagina. D'inverno si sta bene vicino alla finestra grande, dove passa il tubo del riscaldamento e si vede il fiume che scorre lento sotto il ponte.",
    "pt": "Quando a maré baixa, as crianças correm para a praia à procura de conchas e de pequenos caranguejos. Os pescadores, sentados nos barcos virados, consertam as redes e riem de quem cai na lama. Ao fim da tarde todos voltam para casa com sal na pele.",
    "ru": "Зимой деревня засыпала рано: в домах гасли окна, и только собаки лаяли на проходящий поезд. Учитель ещё долго сидел над тетрадями и слушал, как потрескивают дрова в печи. Утром он должен был идти через лес на станцию, потому что обещал встретить сестру.",
    "ja": "祖母の家の裏には小さな川が流れていて、夏になると従兄弟たちと一緒に魚を追いかけた。水は冷たく、石は滑りやすかったが、誰も帰ろうとは言わなかった。夕方になると味噌汁の匂いがして、私たちは濡れた靴のまま走って戻った。",
    "zh": "小镇的车站只有一条铁轨，每天早上都有一列慢车从山里开来。卖豆浆的老人认识所有的乘客，知道谁喜欢加糖，谁在等远方的信。后来火车停了，可是他还是每天把小桌子摆在站台上，说总会有人需要一碗热的东西。",
    "pl": "Kiedy byłem mały, ojciec zabierał mnie w niedzielę nad jezioro, gdzie uczył mnie cierpliwości. Siedzieliśmy godzinami w milczeniu i patrzyliśmy na wodę, a ryby prawie nigdy nie brały. Dopiero teraz rozumiem, że nie chodziło mu wcale o ryby.",
    "nl": "De molen aan de rand van het dorp draait alleen nog op zaterdag, als de wind goed staat en de molenaar tijd heeft. Kinderen mogen dan mee naar boven en kijken hoe het graan tussen de stenen verdwijnt. Daarna krijgt iedereen een warm broodje met boter.",
    "tr": "Sabahları pazara giden kadınlar çeşmenin başında durup birbirlerine haber verirlerdi. Kimin oğlu askerden dönmüş, kimin kızı evlenecek, hepsi orada konuşulurdu. Çocuklar ise testilerin etrafında koşar, annelerinin sözünü dinlemezdi.",
    "poem": "And still the river, broad and brown, goes rolling to the sea, and carries all the leaves of town, and nothing back to me.",
}
LICENCES = [p for p in ("Apache-2.0", "Artistic", "BSD", "CC0-1.0", "GPL-3", "GFDL-1.3", "MPL-2.0") if os.path.exists(f"/usr/share/common-licenses/{p}")]


@pytest.fixture(scope="module")
def prose():
    return spam.Prose.load(spam.MODEL.read_bytes())


def share(prose, text):
    return float(prose.shares([text])[0])


@pytest.mark.parametrize(
    "text",
    [
        "sofa bed " * 60,
        "sofa bed, roof repair, sofa bed, dog kennel, " * 12,
        "#SofaBed #CheapFlights #RoofRepair " * 15,
        LINKS,
        "quillnotes.example · pebbleworks.test · amberfield.invalid · " * 10,
        "buy sofa bed online / sofa bed price / sofa bed review\n" * 12,
        SHEET + "dog kennel Velworth | dog kennel Dunmere | " * 20,
        "格安 航空券 激安 家具 即日 融資 " * 15,
        UNRELATED,
        UNRELATED.replace(" ", "\n"),
        PROSE["en"] + "\n\n" + (UNRELATED + " ") * 3,
    ],
)
def test_piles(prose, text):
    assert share(prose, text) > 0.5


@pytest.mark.parametrize("language", PROSE)
def test_prose_of_many_languages(prose, language):
    assert share(prose, PROSE[language]) < 0.1


@pytest.mark.parametrize("licence", LICENCES)
def test_licences(prose, licence):
    assert share(prose, Path(f"/usr/share/common-licenses/{licence}").read_text("utf-8", "replace")) < 0.1


@pytest.mark.parametrize(
    "text",
    [
        "".join(f"* [Archive](https://quilldesk.example/invoice/{i}): {SHEET}\n" for i in range(6)),
        SHEET * 3 + "\nTags: #archive #notes",
        SHEET + "".join(f"2024-03-0{i} 10:0{i} [INFO] export: token={i}17\n" for i in range(1, 9)) + SHEET,
        PROSE["de"] + "\n\n```\n" + "x = f(a, b)\n" * 40 + "```\n",
        PROSE["ja"] * 3,
        "| key | value |\n| --- | --- |\n" + "| lamp | carpet |\n" * 20 + PROSE["fr"],
    ],
)
def test_links_logs_and_code_among_sentences(prose, text):
    assert share(prose, text) < 0.4


def test_model_is_a_distribution(prose):
    """Probabilities after a context sum to one."""
    total = (2.0 ** -prose.cost.astype(np.float64)).sum(2)
    assert abs(total - 1).max() < 0.02


def test_batches_agree_with_single_texts(prose):
    texts = [*PROSE.values(), "", "sofa bed " * 60, UNRELATED, " ", LINKS]
    assert np.allclose(prose.shares(texts), [share(prose, t) for t in texts])


def test_places_and_repetitions(prose):
    def of(text):
        return prose.sequences([text])[0].tolist()

    word, n = spam.BASES["word"], spam._AGAIN
    # New, recent after another word, the phrase said again; a function word begins a new row, a comma does not.
    assert of("sofa lamp sofa lamp") == [word, word + n, word + 2 * n + 2, word + 3 * n + 3]
    assert of("sofa the chair") == [word, spam.BASES["article"], word]
    assert of("sofa, chair") == [word, spam.BASES[","], word + n]
    assert of("sofa") == of("so\u200bfa")


def test_pages(spark):
    docs = spark.createDataFrame([(1, "sofa bed " * 60, "k"), (1, "sofa bed " * 60, "k"), (2, SHEET * 3, "k"), (3, None, "k"), (4, "", "k"), (5, " " * 500, "k"), (6, "sofa bed", "k"), (7, SHEET * 2000, "k"), (8, "#a #b " * 20_000, "k"), (None, "sofa bed " * 60, "k")], "doc_id bigint, text string, share string")
    assert rows(spam.spam_pages(docs), "doc_id") == [(1,), (1,), (8,)]
    assert spam.spam_pages(docs.limit(0)).count() == 0


def test_long_odd_texts_take_linear_time(prose):
    import time

    for piece in ("a.", "<a ", "[x](", "'", "#", "{\"", "---\n", "```\n", "| a"):
        began = time.time()
        prose.shares([piece * 60_000])
        assert time.time() - began < 5
