"""Term sets of normalised texts as array columns (sets: distinct elements, order of first occurrence)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import TOKEN, query_form, token_text

# Vocabularies of the retrieval rules, in normal form.
QUERY_STOPWORDS = (
    "ما ماذا هل كيف لماذا من في على عن الى إلى او أو هو هي هذا هذه انا اني عندي لدي اريد اعرف السلام عليكم دكتور طبيب".split()
)
GENERIC_TERMS = "دواء الدواء ادويه الادويه علاج العلاج مرض المرض تحليل التحليل تحاليل التحاليل جرعه الجرعه طبيب الطبيب".split()
ANATOMY = (
    "راس دماغ عين اذن انف فم وجه اسنان سن ضرس حلق مريء مري مرئ رقبه صدر رئه قلب بطن معده قولون كبد كليه كلي "
    "ظهر حوض رحم مبيض جلد ابط مفصل ركبه يد ذراع رجل ساق قدم"
).split()
IDENTITY_STOPWORDS = (
    "ما ماذا هل هو هي يوجد اريد اعرف علاج اعراض سبب اسباب فحص تحاليل تحليل مرض حاله مستوي نسبه معدل ارتفاع انخفاض هرمون شديد اكيد "
    "فعال لازم مطلوب صفر انا اني عندي لدي اعاني ممكن يمكن كيف لماذا الذي التي هذا هذه منذ يوم ايام سنه سنوات عمري شخص متزوج متزوجه طفل طفلي "
    "افعل السلام عليكم"
).split()
CONSTRAINTS = (
    "منذ مستمر مستمره متكرر متكرره سابق سابقه طبيعي طبيعيه سلبي سلبيه ايجابي ايجابيه يمين يسار ايمن ايسر طفل طفلي رضيع حامل حمل رجل امراه "
    "ذكر انثي يوم ايام اسبوع اسابيع شهر شهور سنه سنوات عمر لا ليس ليست لم لن بدون غير"
).split()
CONCEPT_EQUIVALENTS = {"نظر": "نظر", "رؤيه": "نظر", "بصر": "نظر", "فمويه": "فم", "فموي": "فم", "كحه": "سعال", "دوار": "دوخه"}
ARTICLES = ("بال", "كال", "لل", "ال")
NEGATIONS = "لا ليس ليست لم لن بدون غير".split()
CONTENT_STOPWORDS = "من في على الى إلى عن مع او أو هذا هذه هو هي قد".split()
VERIFICATION_EQUIVALENTS = {
    "اختبار": "فحص", "تحليل": "فحص", "تحاليل": "فحص", "اجراء": "عمل", "تصوير": "اشعه", "محوسب": "مقطعي", "كمبيوتر": "مقطعي",
    "بالكمبيوتر": "مقطعي", "المقطعي": "مقطعي", "للمخ": "مخ", "بالرنين": "رنين",
}
VERIFICATION_STOPWORDS = "يجب افضل جيد ومن ما اذا كان لتحديد لاكتشاف للتاكد للمريض للمريضه لل ينصح ننصحك انصحك مبدييا".split()
RECOMMENDATIONS = "يجب ينصح ينصحك ننصحك انصحك افضل جيد يتوجب لابد".split()
CLAIM_CUES = {
    "treatment_request": "علاج علاجات يعالج تعالج دواء ادويه دوائيه يستخدم استخدام استعمال تناول تقليل زياده ايقاف وقف اقلاع تجنب مراجعه مضمضه غسول جراحه".split(),
    "symptom_request": "عرض اعراض علامه يشعر الم حمي".split(),
    "diagnosis_request": "تشخيص يشخص يعاني اصابه مرض نتيجه ناتج ناتجا يدل تشير".split(),
    "test_request": "فحص اختبار تحليل تحاليل اشعه تصوير مختبر سونار قياس منظار رنين".split(),
    "cause_request": "سبب اسباب يسبب تسبب ناتج ناتجا نتيجه بسبب يؤدي".split(),
    "prevention_request": "وقايه تجنب منع".split(),
}
ACTIONS = (*RECOMMENDATIONS, *CLAIM_CUES["treatment_request"], *"عمل اجراء فحص اختبار تحليل قياس زياره مراجعه يمكن".split())
INTENT_CUES = {
    "treatment_request": "علاج دواء ادويه يستخدم تناول جراحه".split(),
    "symptom_request": "عرض اعراض علامه يشعر الم حمى".split(),
    "diagnosis_request": "تشخيص يعاني اصابه مرض".split(),
    "test_request": "فحص تحليل تحاليل اشعه تصوير مختبر".split(),
    "cause_request": "سبب اسباب يسبب تسبب ناتج".split(),
    "prevention_request": "وقايه تجنب منع".split(),
}
SPELLINGS = {
    "بروجسترو": "بروجسترون", "البروجسترو": "البروجسترون", "بروجستيرون": "بروجسترون", "البروجستيرون": "البروجسترون",
    "بروجيستيرون": "بروجسترون", "البروجيستيرون": "البروجسترون",
}
GENERIC_PHRASES = "دواء علاج تحاليل تحليل مرض دم التهاب جرعه الم نسبه".split()
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def words(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def mapped(token: Column, table: dict[str, str]) -> Column:
    """table[token], or the token."""
    out = token
    for key, value in table.items():
        out = F.when(token == key, F.lit(value)).otherwise(out)
    return F.when(token.isin(list(table)), out).otherwise(token)


def all_tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))


def token_set(text: Column, normal: bool = False) -> Column:
    return F.array_distinct(all_tokens(text if normal else token_text(text)))


def search_terms(text: Column, limit: int = 24) -> Column:
    """Terms for the lexical index: two characters at least, no stop words, the first limit of them; of a text of stop words only, those."""
    own = all_tokens(token_text(text))
    long_enough = F.filter(own, lambda t: F.length(t) >= 2)
    terms = F.slice(F.array_distinct(F.filter(long_enough, lambda t: ~t.isin(QUERY_STOPWORDS))), 1, limit)
    return F.when(F.size(terms) > 0, terms).otherwise(F.slice(long_enough, 1, limit))


def without_article(token: Column) -> Column:
    """The token without the first article that leaves two characters at least."""
    out = token
    for prefix in reversed(ARTICLES):
        out = F.when(token.startswith(prefix) & (F.length(token) > len(prefix) + 1), F.substring(token, len(prefix) + 1, 1 << 20)).otherwise(out)
    return out


def strip_article(norm: Column) -> Column:
    return F.when(norm.startswith("ال") & (F.length(norm) > 2), F.substring(norm, 3, 1 << 20)).otherwise(norm)


def content_terms(tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: F.length(t) > 1), without_article))


def _tail(token: Column, n: int) -> Column:
    return F.substring(token, n + 1, 1 << 20)


def anatomy_terms(tokens: Column) -> Column:
    """Anatomical words among the tokens' forms without conjunction, article, possessive and preposition."""

    def begins(t: Column) -> Column:
        bare = F.when((t.startswith("و") | t.startswith("ف")) & (F.length(t) > 3), _tail(t, 1))
        base = F.coalesce(bare, t)
        return F.array_compact(F.array(t, bare, F.when(without_article(base) != base, without_article(base))))

    def ends(t: Column) -> Column:
        n = F.length(t)
        one = F.when(F.substring(t, -1, 1).isin("ي", "ك", "ه") & (n > 3), t.substr(F.lit(1), n - 1))
        two = F.when(F.substring(t, -2, 2).isin("ها", "نا") & (n > 4), t.substr(F.lit(1), n - 2))
        return F.array_compact(F.array(t, one, two))

    def prepositions(t: Column) -> Column:
        return F.array_compact(F.array(t, F.when((t.startswith("ب") | t.startswith("ل")) & (F.length(t) > 3), _tail(t, 1))))

    # only words in the script of the vocabulary (which lies above all Latin letters) can have such a form
    own = F.filter(tokens, lambda t: t >= F.lit("\u0621"))
    forms = F.flatten(F.transform(F.flatten(F.transform(F.flatten(F.transform(own, begins)), ends)), prepositions))
    return F.array_intersect(forms, words(ANATOMY))


def identity_tokens(tokens: Column) -> Column:
    return F.filter(content_terms(tokens), lambda t: ~t.isin(IDENTITY_STOPWORDS) & (F.length(t) > 2) & ~t.rlike(r"[\p{Nd}²³¹]"))


def concepts(tokens: Column, anatomy: Column | None = None) -> Column:
    """Identity tokens and anatomical words (anatomy: those, if they are at hand), equal ones under one name."""
    return F.array_distinct(F.transform(F.array_union(identity_tokens(tokens), anatomy_terms(tokens) if anatomy is None else anatomy), lambda t: mapped(t, CONCEPT_EQUIVALENTS)))


def constraint_terms(text: Column, tokens: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: F.concat(F.lit("number:"), n))
    return F.array_union(F.array_intersect(content_terms(tokens), words(CONSTRAINTS)), numbers)


def claim_tokens(tokens: Column) -> Column:
    """Content tokens of the claim checks: no stop words, no article, no leading conjunction."""

    def reduce_(t: Column) -> Column:
        bare = F.when(t.startswith("ال"), _tail(t, 2)).otherwise(t)
        bare = F.when(bare.startswith("و") & (F.length(bare) > 3), _tail(bare, 1)).otherwise(bare)
        # most tokens have neither, which is told first
        return F.when(t.startswith("ال") | t.startswith("و"), F.when(bare == "", t).otherwise(bare)).otherwise(t)

    return F.array_distinct(F.transform(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(CONTENT_STOPWORDS)), reduce_))


def verification_tokens(tokens: Column) -> Column:
    return verified(claim_tokens(tokens))


def verified(own: Column) -> Column:
    """The verification tokens of a text's claim tokens."""
    kept = F.filter(own, lambda t: ~t.isin(VERIFICATION_STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda t: mapped(t, VERIFICATION_EQUIVALENTS)))


def share(part: Column, whole: Column) -> Column:
    """|part and whole| / |whole|, 0 for an empty side; both sets."""
    both = F.size(F.array_intersect(part, whole))
    return F.when((F.size(part) > 0) & (F.size(whole) > 0), both / F.size(whole)).otherwise(F.lit(0.0))


def is_generic(text: Column) -> Column:
    norm = query_form(text)
    bare = F.when(norm.startswith("ال"), _tail(norm, 2)).otherwise(norm)
    return norm.isin(GENERIC_TERMS) | bare.isin(sorted({t.removeprefix("ال") for t in GENERIC_TERMS}))


def spelling_variant(norm: Column) -> Column:
    """The text with words in their usual spelling, null if nothing changes."""
    out = F.array_join(F.transform(F.split(norm, " "), lambda t: mapped(t, SPELLINGS)), " ")
    return F.when((out != "") & (out != norm), out)


def intent_support(intent: Column, tokens: Column) -> Column:
    """1 if the text has a cue of the intent, 0 if not, 0.5 for intents without cues."""
    bare = F.transform(tokens, lambda t: F.when(t.startswith("ال"), _tail(t, 2)).otherwise(t))
    out = F.lit(0.5)
    for name, cues in INTENT_CUES.items():
        out = F.when(intent == name, F.when(F.arrays_overlap(bare, words(cues)), 1.0).otherwise(0.0)).otherwise(out)
    return out
