"""Which language a short text is in, by dictionaries of function words and by script."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

#: Function and question words by language: articles, prepositions, conjunctions, pronouns, auxiliaries (fixed lists; words shared by
#: languages count for each in part).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as by at from are be this which what who whom whose how much many did does do done between both we so against while into per these those has have had not no nor other another than then there their them they you your or its were will would can could should may might must shall about over under after before only out if an a each some any all such also more most very our us he she his her i my me when where why because although though during since until",
    "de": "der die das und in den von zu mit auf für ist im des dem nicht kein keine ein eine einen einem einer eines wie viel viele um hat haben hatte sich bis zwischen war waren wird werden wurde wurden worden durch bei beim nach vor aus so man es er sie ihr ihre wir uns ich mir mich du alles was wer wo wann warum auch noch nur sehr mehr als dass daß weil wenn ob oder aber sondern über unter gegen ohne diese dieser dieses diesen kann können konnte muss soll sind sein seine am vom zum zur an da dort hier beide",
    "fr": "le la les l des de d du un une et ou où dans que qu qui quoi dont pour par sur sous est sont était étaient être été a ont avait au aux avec sans ce cet cette ces il ils elle elles on nous vous je tu me se sa son ses leur leurs notre votre mais si ne n pas plus moins très entre quel quelle quels quelles combien comment quand pourquoi donc car comme aussi même après avant depuis chez contre en y autre autres tout toute tous toutes c s j",
    "es": "el la los las lo de del y e o u en que un una unos unas por para con sin es son fue fueron era eran ser ha han había se su sus al a entre cuál cuáles cuánto cuánta cuántos cuántas cómo qué quién dónde cuándo no ni más menos muy pero como si ya también este esta esto estos estas ese esa otro otra otros otras todo toda todos todas hasta desde sobre según durante donde cuando porque aunque nos nosotros yo me mi le les hay",
    "pt": "o a os as de do da dos das e ou em no na nos nas que um uma uns umas por pelo pela para com sem é são foi foram era ser ter tem há se seu sua seus suas ao aos à às entre qual quais quanto quanta quantos quantas como quem onde quando porque não nem mais menos muito mas já também este esta isto esse essa isso outro outra outros outras todo toda todos todas até desde sobre eu nós você ele ela eles elas me lhe",
    "it": "il lo la i gli le l di del dello della dei degli delle e ed o in nel nella nei nelle che un uno una per con senza è sono era erano fu essere ha hanno aveva si suo sua suoi loro al allo alla ai alle dal dalla dai tra fra su sul sulla quale quali quanto quanta quanti quante come chi dove quando perché non né più meno molto ma anche già questo questa questi queste quello quella altro altra altri altre tutto tutti io noi mi ci se",
    "nl": "de het een en van in is dat op te met voor zijn niet geen aan er om wat wie waar hoe veel door tussen bij uit ook was waren werd worden wordt deze dit die naar als dan over onder maar of wij we ik je u hij zij ze hun haar zijn heeft hebben had kan kunnen moet zal zou nog al wel meer tot tegen na voor toen omdat welke",
    "pl": "i w we z ze na do nie się jest są był była było były być to że żeby o od po za przez dla jak jaki jaka jakie ile co kto gdzie kiedy dlaczego między oraz lub albo ale ten ta te tym tego tej tych on ona oni my nas ja mnie jego jej ich który która które już tylko także bardzo bez przed przy ma mają może",
    "sv": "och i att det den de som en ett på är var av för med till från inte om hur vad vem var när varför mycket många mellan både vi oss jag du han hon detta denna dessa har hade kan ska skulle eller men också så än där här vid efter under över utan sin sitt sina deras blev",
    "da": "og i at det den de som en et på er var af for med til fra ikke om hvor hvad hvem hvornår hvorfor meget mange mellem både vi os jeg du han hun dette denne disse har havde kan skal skulle eller men også så end der her ved efter under over uden sin sit sine deres blev",
    "no": "og i at det den de som en et på er var av for med til fra ikke om hvor hva hvem når hvorfor mye mange mellom både vi oss jeg du han hun dette denne disse har hadde kan skal skulle eller men også så enn der her ved etter under over uten sin sitt sine deres ble",
    "fi": "ja on ei ole oli olivat se ne että en et hän he me minä sinä joka jotka mitä mikä kuka missä milloin miksi kuinka miten tai mutta myös kun jos niin kuin ovat olla vain jo sekä ennen jälkeen kanssa ilman välillä tämä nämä sen sitä koska vaikka",
    "cs": "a i v ve na je se že to s z ze do o po za pro při od k ke který která které jak jaký kolik kdo kde kdy proč mezi nebo ale byl byla bylo byly být jsou není ten ta tento tato tyto jeho její jejich my já už jen také bez před",
    "ro": "și în de la cu pe din pentru este sunt a fost au era că care ce cine cum cât când unde un o al ai ale nu mai sau dar între prin după fără acest această acestea lor lui ei noi eu se să",
    "hu": "a az és hogy nem is egy ez azt volt voltak van vannak meg már csak mint mi ki hol mikor miért hogyan mennyi között vagy de ha amely aki ezek ezt után előtt nélkül lesz én ő ők",
    "tr": "ve bir bu şu o ile için da de ne kim nerede nasıl neden kadar olarak arasında olan oldu daha çok en ki gibi değil var yok ama veya her ben biz siz onlar sonra önce göre",
    "id": "dan yang di ke dari untuk dengan pada adalah ini itu tidak akan atau juga oleh sebagai dalam antara apa siapa berapa bagaimana kapan mengapa saya kami kita mereka sudah telah dapat lebih karena tetapi",
    "vi": "và của là các một những trong có được cho với không này đó khi từ đến về theo như đã sẽ cũng nhưng hoặc bao nhiêu nào ai tôi chúng họ giữa",
}
_OWNERS: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _OWNERS.setdefault(_w, []).append(_lang)
_WEIGHT = {w: [(lang, 1.0 / len(owners)) for lang in owners] for w, owners in _OWNERS.items()}
_TOKENS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*", re.U)
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|`[^`\n]*`")
_SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("ko", re.compile(r"[가-힣]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
)
_LETTER = {"ß": "de", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "œ": "fr", "ł": "pl", "å": "sv", "ı": "tr"}
#: Weight that the leading language needs, and its least ratio to the next.
LEAST_WEIGHT, LEAST_RATIO = 1.3, 1.4


def scores(text: str, counts: Counter | None = None) -> dict[str, float]:
    """Weight of each language in ``text``, quoted terms left out; ``counts`` are its lower-case words where they are known already."""
    found: dict[str, float] = defaultdict(float)
    if not text.isascii():
        text = _QUOTED.sub(" ", text)
        for lang, rx in _SCRIPTS:
            n = len(rx.findall(text))
            if n:
                found[lang] += n / (1 if lang in ("zh", "ja", "ko") else 3)
        for c, lang in _LETTER.items():
            if c in text:
                found[lang] += 0.7
    elif '"' in text or "`" in text:
        text = _QUOTED.sub(" ", text)
    for w, n in (Counter(_TOKENS.findall(text.lower())) if counts is None else counts).items():
        if w in _WEIGHT:
            for lang, weight in _WEIGHT[w]:
                found[lang] += n * weight
    return found


def language(text: str | None, counts: Counter | None = None) -> str | None:
    """The language of ``text``, or None where the dictionaries cannot tell; null and wordless texts give None."""
    if not text:
        return None
    ranked = sorted(scores(text, counts).items(), key=lambda x: -x[1])[:2]
    if not ranked or ranked[0][1] < LEAST_WEIGHT:
        return None
    return ranked[0][0] if len(ranked) == 1 or ranked[0][1] >= LEAST_RATIO * ranked[1][1] else None
