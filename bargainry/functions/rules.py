"""Rule tables for categories, departments, brands, keywords and coupons, and columns that apply them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, let

# Category, weight, patterns.
CATEGORY_RULES = (
    ("toys-games", 12, (
        r"\b(lego|playmobil|duplo|hot wheels|barbie|nerf|paw patrol|bluey|pokemon|pok[eé]mon)\b",
        r"\b(board game|jigsaw|puzzles?|action figure|dollhouses?|plush toys?|stuffed animal)\b",
        r"\b(play ?set|play ?doh|magna[- ]?tiles|building blocks|toys?)\b",
        r"\b(squishmallow|funko|hatchimals|l\.?o\.?l\.? surprise)\b",
    )),
    ("baby-kids", 11, (
        r"\b(strollers?|car seat|bassinets?|cribs?|high ?chair|playpens?|baby monitors?)\b",
        r"\b(diapers?|pampers|huggies|formula|nursing|breast pump|swaddles?|onesies?)\b",
        r"\b(toddler|infant|newborn|baby|b[eé]b[eé])\b",
    )),
    ("gaming", 11, (
        r"\b(playstation|ps5|ps4|xbox|nintendo|switch|steam deck)\b",
        r"\b(gaming (?:chair|headset|mouses?|keyboards?|monitors?)|controller|dualsense)\b",
        r"\b(video game|gpu|geforce|radeon|rtx \d{4})\b",
    )),
    ("computers", 10, (
        r"\b(laptops?|notebooks?|macbook|chromebooks?|ultrabooks?|desktop pc|all[- ]in[- ]one pc)\b",
        r"\b(ssd|nvme|hard drive|hdd|ram|ddr[45]|motherboard|cpu|processor|ryzen|intel core)\b",
        r"\b(monitors?|printers?|routers?|modems?|keyboards?|mouses?|webcams?|docking station)\b",
        r"\b(ipads?|tablets?|surface pro|thinkpad|inspiron|xps)\b",
    )),
    ("electronics", 9, (
        r"\b(tv|oled|qled|4k|8k|smart tv|soundbar|home theatre|home theater)\b",
        r"\b(headphones?|earbuds?|airpods?|speakers?|bluetooth speakers?|turntables?|receivers?)\b",
        r"\b(iphones?|galaxy|pixel|smartphones?|smart ?watch|apple watch|fitbit|garmin)\b",
        r"\b(cameras?|dslr|mirrorless|gopro|drones?|projectors?|kindle|e-?reader)\b",
    )),
    ("appliances", 9, (
        r"\b(refrigerators?|fridges?|freezers?|dishwashers?|washers?|dryers?|washing machine)\b",
        r"\b(range hood|cooktop|wall oven|stoves?|microwaves?|air conditioners?|dehumidifiers?)\b",
        r"\b(vacuums?|dyson|roomba|robot vacuums?|steam mop)\b",
    )),
    ("kitchen", 8, (
        r"\b(air fryer|instant pot|slow cooker|pressure cooker|blenders?|food processor)\b",
        r"\b(coffee ?maker|espresso|keurig|nespresso|kettles?|toasters?|waffle maker)\b",
        r"\b(cookware|frying pan|saucepans?|dutch oven|knife set|cutting board|bakeware)\b",
        r"\b(dinnerware|mixing bowl|stand mixer|kitchenaid)\b",
    )),
    ("shoes-accessories", 8, (
        r"\b(sneakers?|running shoes?|boots?|sandals?|loafers?|heels?|slippers?)\b",
        r"\b(handbags?|purses?|backpacks?|wallets?|belts?|sunglasses|watch band|jewellery|jewelry)\b",
        r"\b(nike|adidas|new balance|skechers|birkenstock|blundstone|converse|vans)\b",
    )),
    ("clothing", 7, (
        r"\b(jackets?|coats?|parkas?|hoodies?|sweaters?|cardigans?|fleeces?|vests?)\b",
        r"\b(jeans|pants?|chinos|leggings|joggers|shorts|skirt|dress|blouse|shirt|tee|t-shirt)\b",
        r"\b(pyjamas|pajamas|nightgowns?|underwear|socks|bras?|swimsuit|activewear|outerwear)\b",
        r"\b(sweatshirts?|blazers?|suits?|tank top|polo|bodysuits?|overcoats?|trousers?)\b",
        r"\b(sweatpants?|trackpants?|beanie|toque|scarf|mitts?|gloves?|overall|bib)\b",
    )),
    ("sports-outdoors", 8, (
        r"\b(bikes?|bicycles?|kayaks?|canoes?|paddle ?board|camping|tents?|sleeping bag|backpacking)\b",
        r"\b(treadmills?|dumbbells?|kettlebells?|yoga mat|exercise bikes?|home gym|weights?)\b",
        r"\b(skis?|snowboards?|hockey|golf|fishing|hiking|climbing|coolers?)\b",
    )),
    ("tools-auto", 8, (
        r"\b(drills?|impact driver|circular saw|mitre saw|miter saw|sanders?|tool ?set|socket set)\b",
        r"\b(dewalt|milwaukee|makita|ryobi|mastercraft|bosch tool)\b",
        r"\b(tires?|tyres?|motor oil|wiper blade|car battery|jack stand|snow brush)\b",
        r"\b(lawn ?mower|snow ?blower|pressure washers?|generators?|ladders?)\b",
    )),
    ("beauty-health", 8, (
        r"\b(shampoos?|conditioners?|moisturizers?|serums?|sunscreen|cleansers?|makeup|mascaras?)\b",
        r"\b(lipsticks?|foundation|perfumes?|colognes?|fragrance|skincare|face mask)\b",
        r"\b(electric (?:razor|toothbrush)|hair dryers?|straightener|curling iron|trimmer)\b",
        r"\b(vitamins?|supplements?|protein powder|first aid|thermometers?)\b",
    )),
    ("grocery", 7, (
        r"\b(coffee beans|ground coffee|tea bags|cereal|pasta|olive oil|snacks?|chocolate bar)\b",
        r"\b(grocery|produce|frozen (?:pizza|food)|canned|granola|chips|candy)\b",
    )),
    ("home", 6, (
        r"\b(sofas?|couchs?|sectionals?|armchairs?|dining table|bed frame|mattresss?|dressers?|nightstands?)\b",
        r"\b(bedding|duvets?|comforters?|sheet set|pillows?|towels?|curtains?|rugs?|blankets?)\b",
        r"\b(lamps?|lighting|shelfs?|bookcases?|storage bin|organizers?|d[eé]cor|mirrors?)\b",
        r"\b(patio|outdoor furniture|bbq|barbecue|grills?)\b",
    )),
    ("travel", 7, (
        r"\b(flights?|airfare|hotels?|resorts?|all[- ]inclusive|vacation package|cruises?)\b",
        r"\b(luggages?|suitcases?|carry[- ]on|travel adapter)\b",
    )),
)

# What a merchant mostly sells.
MERCHANT_HINTS = {
    "computers": ("canada-computers", "memory-express", "newegg", "staples"),
    "electronics": ("best-buy", "the-source", "visions-electronics"),
    "toys-games": ("toys-r-us", "mastermind-toys", "lego", "shopdisney"),
    "baby-kids": ("snuggle-bugz", "west-coast-kids", "babies-r-us", "carters-oshkosh"),
    "clothing": ("childrens-place", "old-navy", "gap", "gap-factory", "banana-republic", "athleta", "reitmans", "rw-co", "penningtons", "roots", "aritzia", "uniqlo", "marks"),
    "shoes-accessories": ("softmoc", "dsw-canada", "aldo", "little-burgundy"),
    "sports-outdoors": ("sportchek", "atmosphere", "mec", "sail", "golf-town", "decathlon"),
    "tools-auto": ("canadian-tire", "partsource"),
    "home": ("home-depot", "rona", "home-hardware", "ikea", "wayfair", "structube", "leons", "the-brick"),
    "beauty-health": ("sephora", "the-body-shop", "lush", "bath-body-works", "well-ca", "shoppers-drug-mart"),
    "grocery": ("loblaws", "real-canadian-superstore", "no-frills", "metro", "sobeys", "giant-tiger"),
}

# Department and patterns, the first that fits.
DEPARTMENT_RULES = (
    ("baby", (r"\b(baby|infant|newborn|0-24 months|preemie|b[eé]b[eé])\b", r"\b(car seat|crib|bassinet|stroller|playpen|swaddle|onesie|bunting bag)\b")),
    ("girls", (r"\b(girls?'?s?|toddler girl|junior girls?)\b",)),
    ("boys", (r"\b(boys?'?s?|toddler boy|junior boys?)\b",)),
    ("women", (r"\b(women'?s?|ladies'?|womens|female|maternity)\b", r"\b(blouse|bodysuit|nightgown|bra|camisole|skort|jumpsuit|romper)\b")),
    ("men", (r"\b(men'?s?|mens|male|man'?s)\b", r"\b(necktie|cummerbund)\b")),
)
DEPARTMENT_HINTS = (
    ("baby", r"\b(baby|infant|newborn)\b"), ("girls", r"\b(girl)"), ("boys", r"\b(boy)"),
    ("women", r"\b(women|ladies|female)"), ("men", r"\b(men|male)"), ("unisex", r"\b(unisex|all)\b"),
)
ONE_DEPARTMENT = {
    "women": ("penningtons", "reitmans", "rw-co", "cleo", "suzy-shier", "rickis", "northern-reflections", "athleta"),
    "men": ("tip-top-tailors", "moores", "bootlegger"),
}
APPAREL = ("clothing", "shoes-accessories", "baby-kids")

# Brands that titles name.
BRANDS = (
    "Apple", "Samsung", "Sony", "LG", "Google", "Bose", "JBL", "GoPro", "Dyson", "Philips", "Dell", "Lenovo", "HP", "Asus", "Acer",
    "Logitech", "Corsair", "Razer", "Seagate", "Nintendo", "PlayStation", "Xbox", "LEGO", "Hot Wheels", "Paw Patrol", "Barbie", "Nerf",
    "Crayola", "Ravensburger", "Melissa & Doug", "Magna-Tiles", "Squishmallows", "Nike", "Adidas", "Under Armour", "Columbia",
    "Blundstone", "Roots", "Lululemon", "Levi's", "Carhartt", "Patagonia", "Canada Goose", "The North Face", "Uniqlo", "Instant Pot",
    "Ninja", "KitchenAid", "Nespresso", "Keurig", "Weber", "Coleman", "YETI", "DEWALT", "Makita", "Milwaukee", "Bosch", "Mastercraft",
    "Michelin", "Bridgestone", "Graco", "Britax", "Pampers", "Huggies", "CeraVe", "La Roche-Posay", "Olay", "Kirkland", "Bauer", "CCM",
    "NordicTrack", "Garmin", "Fitbit", "Kindle", "Kobo", "Duracell",
)

# What shoppers call things, and patterns for it.
KEYWORDS = {
    "table": (r"\bconsole\s+(?:table|desk)\b", r"\bconsole\b(?=.*\b(?:wood|oak|walnut|marble|drawer|shelf|entryway|hallway|living)\b)", r"\b(?:sideboard|buffet|credenza|bureau)\b", r"\b(?:nightstand|night stand|bedside)\b", r"\b(?:coffee|dining|dinette|bistro|accent|end|side|coctail|cocktail)\s+table\b", r"\btables?\b", r"\bdesks?\b"),
    "sofa": (r"\b(?:sofa|couch|settee|davenport|chesterfield)\b", r"\b(?:sectional|loveseat|love seat|futon|divan)\b"),
    "chair": (r"\bchairs?\b", r"\b(?:stool|bar ?stool|counter ?stool|recliner|armchair|arm chair)\b", r"\b(?:ottoman|pouf|poof|footstool)\b", r"\bbenche?s?\b"),
    "storage": (r"\b(?:dresser|chest of drawers|armoire|wardrobe|chiffonier)\b", r"\b(?:bookcase|bookshel(?:f|ves)|shelving|cabinet|cupboard)\b", r"[eé]tag[eè]re", r"\b(?:tv stand|media (?:unit|console|centre|center)|entertainment (?:unit|centre|center))\b"),
    "bed": (r"\b(?:bed ?frame|headboard|bunk bed|daybed|day bed|platform bed)\b", r"\b(?:mattress|box ?spring)\b", r"\bbeds?\b"),
    "bedding": (r"\b(?:duvet|douillette|comforter|coverlet|quilt|sham|pillowcase)\b", r"\b(?:sheet set|fitted sheet|flat sheet|bedding|bed linen)\b"),
    "lamp": (r"\b(?:lamps?|sconce|chandelier|pendant light|floor lamp|table lamp)\b", r"\b(?:luminaire|light fixture|lighting)\b"),
    "rug": (r"\b(?:rugs?|carpet|runner|broadloom|tapis)\b", r"\b(?:doormat|door mat)\b"),
    "curtains": (r"\b(?:curtains?|drapes?|drapery|blinds?|valance|sheers?)\b",),
    "mirror": (r"\bmirrors?\b", r"\bmiroirs?\b"),
    "laptop": (r"\b(?:laptops?|notebook computer|macbook|chromebook|ultrabook)\b",),
    "tv": (r"\b(?:televisions?|smart tv|\btvs?\b|oled|qled|t[ée]l[ée]viseur)\b",),
    "headphones": (r"\b(?:headphones?|earbuds?|earphones?|headsets?)\b", r"[eé]couteurs"),
    "coat": (r"\b(?:coats?|jackets?|parkas?|anoraks?|windbreakers?|manteaux?)\b", r"\b(?:puffer|shell|softshell|raincoat)\b"),
    "boots": (r"\b(?:boots?|bottes?|booties|chelsea|wellington)\b",),
    "shoes": (r"\b(?:shoes?|sneakers?|trainers?|loafers?|sandals?|heels?|moccasins?)\b", r"\b(?:ballet flats?|running shoes?)\b", r"\b(?:chaussures?|espadrilles?)\b"),
    "earrings": (r"\b(?:earrings?|hoops?|studs?|boucles d'oreilles)\b",),
    "necklace": (r"\b(?:necklaces?|pendants?|chokers?|collier)\b",),
    "jewellery": (r"\b(?:jewell?ery|bijoux)\b", r"\b(?:earrings?|hoops?|necklaces?|pendants?|bracelets?|bangles?|brooch(?:es)?|anklets?)\b", r"\b(?:signet|stacking|cocktail|engagement|eternity) ring\b"),
    "bag": (r"\b(?:bags?|handbags?|purses?|totes?|clutch(?:es)?|satchels?|crossbody|cross-body)\b", r"\b(?:backpacks?|knapsacks?|duffels?|duffles?|sacs?)\b"),
    "wallet": (r"\b(?:wallets?|cardholders?|card holders?|portefeuilles?)\b",),
    "watch": (r"\b(?:watch(?:es)?|smartwatch(?:es)?|montres?)\b",),
    "dress": (r"\b(?:dress(?:es)?|gowns?|sundress(?:es)?|robes?)\b",),
    "shirt": (r"\b(?:shirts?|blouses?|tees?|t-shirts?|polos?|tunics?|camisoles?|tank tops?)\b", r"\b(?:bodysuits?|chemisiers?)\b"),
    "sweater": (r"\b(?:sweaters?|cardigans?|pullovers?|jumpers?|hoodies?|sweatshirts?|crewnecks?)\b", r"\b(?:chandails?|tricots?)\b"),
    "pants": (r"\b(?:pants?|trousers?|chinos?|leggings?|joggers?|sweatpants?|pantalons?)\b", r"\b(?:jeans|denim)\b"),
    "skirt": (r"\b(?:skirts?|jupes?)\b",),
    "toy": (r"\b(?:toys?|plush(?:ies)?|stuffed animals?|figurines?|action figures?|dolls?)\b", r"\b(?:puzzles?|board games?|play ?sets?|building blocks?|jouets?)\b"),
    "stroller": (r"\b(?:strollers?|pushchairs?|prams?|travel systems?|poussettes?)\b",),
    "car seat": (r"\b(?:car ?seats?|booster seats?|infant seats?)\b",),
    "diapers": (r"\b(?:diapers?|nappies|couches jetables)\b",),
    "cookware": (r"\b(?:cookware|skillets?|saucepans?|frying pans?|dutch ovens?|stockpots?|casseroles?)\b", r"\b(?:bakeware|roasting pans?|sheet pans?)\b"),
    "vacuum": (r"\b(?:vacuums?|vacuum cleaners?|aspirateurs?)\b",),
    "kettle": (r"\b(?:kettles?|bouilloires?)\b",),
    "towel": (r"\b(?:towels?|bath sheets?|serviettes?|washcloths?)\b",),
    "phone": (r"\b(?:smartphones?|cell ?phones?|iphones?|t[ée]l[ée]phones?)\b", r"\b(?:galaxy s\d+|pixel \d+)\b"),
    "tablet": (r"\b(?:tablets?|ipads?|tablettes?)\b",),
    "monitor": (r"\b(?:monitors?|[ée]crans?)\b",),
}
DEFINITION_CHARS = 80

# How texts name coupon codes, most specific first; CODE stands for the code.
_CODE = "([A-Z0-9][A-Z0-9_-]{2,19})"
COUPONS = (
    rf"\b(?:promo|coupon|discount|voucher)\s*code\s*[:=-]?\s*{_CODE}\b",
    rf"\buse\s+(?:the\s+)?code\s*[:=-]?\s*{_CODE}\b",
    rf"\bwith\s+(?:promo\s+|coupon\s+)?code\s*[:=-]?\s*{_CODE}\b",
    rf"\bapply\s+code\s*[:=-]?\s*{_CODE}\b",
    rf"\benter\s+code\s*[:=-]?\s*{_CODE}\b",
    rf"\bcode\s*[:=]\s*{_CODE}\b",
    rf"\bcode\s+{_CODE}\s+at\s+checkout\b",
    rf"\b{_CODE}\s+at\s+checkout\b",
    rf"\bcoupon\s*[:=]\s*{_CODE}\b",
)
NO_COUPON = r"\b(?:no|without|not?)\s+(?:promo\s+|coupon\s+|discount\s+)?code\s+(?:needed|required|necessary)\b|\bno\s+code\b|\bcode\s+not\s+required\b|\bautomatically\s+applied\b|\bno\s+coupon\b"
NOT_CODES = (
    "AT", "IN", "ON", "TO", "IS", "IT", "OR", "AND", "THE", "FOR", "YOU", "YOUR", "WILL", "WITH", "FROM", "THIS", "THAT", "WHEN", "ABOVE",
    "BELOW", "HERE", "NEEDED", "REQUIRED", "APPLIED", "VALID", "EXPIRES", "ONLY", "ALSO", "PLUS", "FREE", "SALE", "OFF", "NOW", "NEW",
    "ALL", "SHIPPING", "CHECKOUT", "ONLINE", "STORE", "PRICE", "DEAL", "DEALS", "ITEM", "ITEMS", "ORDER", "ORDERS", "CART",
    "AUTOMATICALLY", "WORDS", "WORD", "BASE", "AREA", "POSTAL", "ZIP", "ERROR", "STATUS", "REVIEW", "SOURCE", "QUALITY",
)

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The edge before what can only start with a word's character.
_START = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
#: A group of alternatives without groups of their own that may be left out, each from a letter or digit on that has to be there.
_WORDS = re.compile(r"\\b\((?:\?:)?((?:[a-z0-9](?![?*{])[^|()]*)(?:\|[a-z0-9](?![?*{])[^|()]*)*)\)(?![?*{])")


def ascii_words(pattern: str) -> str:
    """The pattern for the JVM: no case, and word edges that know ASCII only."""
    at = 2 if _WORDS.match(pattern) and "|" not in _WORDS.sub("", pattern, count=1) else 0
    return "(?iu)" + (_START if at else "") + pattern[at:].replace(r"\b", _EDGE)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_words(pattern))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = matches(text, patterns[0])
    for p in patterns[1:]:
        out = out | matches(text, p)
    return out


def _lookup(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, keys in table.items():
        out = F.when(key.isin(*keys), F.lit(value)).otherwise(out)
    return out


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def told_category(title: Column, description: Column, hint: Column) -> Column:
    """struct(score, order, name) of the rule with most weight (two more for each further pattern); null if none fits."""

    def scored(text: Column) -> Column:
        def score(i: int, weight: int, patterns: tuple[str, ...], name: str) -> Column:
            hits = sum((matches(text, p).cast("int") for p in patterns), F.lit(0))
            return F.when(hits > 0, F.struct((weight + (hits - 1) * 2).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))

        return F.array_max(F.array(*[score(i, w, p, n) for i, (n, w, p) in enumerate(CATEGORY_RULES)]))

    return let(_joined(title, description, hint), scored)


def settled_category(told: Column, merchant: Column) -> Column:
    """The category that texts tell; a weak one yields to the merchant."""
    known = _lookup(MERCHANT_HINTS, merchant)
    return let(told, lambda b: F.when(b.isNull(), F.coalesce(known, F.lit("other"))).when(known.isNotNull() & (b["score"] <= 7), known).otherwise(b["name"]))


def category(title: Column, description: Column, merchant: Column, hint: Column) -> Column:
    return settled_category(told_category(title, description, hint), merchant)


def told_department(title: Column, description: Column, hint: Column) -> Column:
    """What the hint names, else the texts."""
    told = F.lit(None).cast("string")
    for name, pattern in reversed(DEPARTMENT_HINTS):
        told = F.when(matches(hint, pattern), F.lit(name)).otherwise(told)

    def read(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, patterns in reversed(DEPARTMENT_RULES):
            out = F.when(_any(text, patterns), F.lit(name)).otherwise(out)
        return out

    return F.coalesce(told, let(_joined(title, description), read))


def settled_department(told: Column, merchant: Column, kind: Column) -> Column:
    """The department that texts tell, else the merchant's, else what the category lets one expect."""
    rest = F.when(kind.isin(*APPAREL), F.lit("unisex")).otherwise(F.lit("na"))
    return F.coalesce(told, _lookup(ONE_DEPARTMENT, F.lower(merchant)), rest)


def department(title: Column, description: Column, hint: Column, merchant: Column, kind: Column) -> Column:
    return settled_department(told_department(title, description, hint), merchant, kind)


def brand(title: Column | str) -> Column:
    """The longest brand that the title names, the earlier of the list if two are as long."""
    ordered = sorted(BRANDS, key=lambda b: -len(b))  # stable
    out = F.lit(None).cast("string")
    for name in reversed(ordered):
        out = F.when(col(title).rlike(f"(?i)(^|[^\\w]){re.escape(name)}([^\\w]|$)"), F.lit(name)).otherwise(out)
    return out


def keywords(title: Column, description: Column, hint: Column) -> Column:
    """What shoppers call it, sorted and with spaces around; null if no rule fits."""
    first = F.get(F.split(F.trim(F.coalesce(description, F.lit(""))), r"(?<=[.!?])\s+"), F.lit(0))
    defining = F.when(F.length(first) <= DEFINITION_CHARS, first)
    found = let(_joined(title, defining, hint), lambda t: F.array_compact(F.array(*[F.when(_any(t, p), F.lit(term)) for term, p in sorted(KEYWORDS.items())])))
    return let(found, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(" "), F.array_join(f, " "), F.lit(" "))))


def coupon(text: Column | str) -> Column:
    """struct(code, text): the first code that stands up, and the text without its phrase; else null."""

    def find(t: Column) -> Column:
        out = F.lit(None).cast("struct<code:string,text:string>")
        for pattern in reversed(COUPONS):
            whole = ascii_words(pattern)
            code = F.upper(F.regexp_extract(t, whole, 1))
            part_number = code.rlike(r"^[A-Z]{1,3}-?\d{3,}-?[A-Z]*$") & code.contains("-")
            sound = (code != "") & ~code.isin(*NOT_CODES) & code.rlike("[A-Z]") & ~part_number
            at = F.instr(t, F.regexp_extract(t, whole, 0))
            phrase = F.length(F.regexp_extract(t, whole, 0))
            without = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + phrase, F.length(t)))
            out = F.when(sound, F.struct(code.alias("code"), F.trim(F.regexp_replace(without, r"\s{2,}", " ")).alias("text"))).otherwise(out)
        return F.when(~matches(t, NO_COUPON), out)

    return let(F.trim(F.coalesce(col(text), F.lit(""))), find)
