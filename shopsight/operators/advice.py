"""Rule-based advice and model prompts as columns.

No model is called: the prompt text is produced as a column for an outside
service, and the rule-based fallback text is what the reference returns when
no model answers.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.scalar import _c, clean_advice

# Fixed values that must equal the reference (rule-based fallback texts).
ADVICE_TOP = ("Запропонуйте преміальний статус та ексклюзивні умови обслуговування. "
              "Надішліть персональне привітання від керівника компанії.")
ADVICE_RISK = ("Надішліть знижку двадцять відсотків на категорію товарів, яку клієнт купував раніше. "
               "Запропонуйте телефонний дзвінок для з'ясування причин відсутності активності.")
ADVICE_DEFAULT = ("Надішліть добірку найпопулярніших товарів вашої ніші. "
                  "Запропонуйте безкоштовну доставку при наступному замовленні.")
BUNDLE_TEMPLATE = ("Створіть акційний набір із товарів «%s» та «%s» зі знижкою десять відсотків. "
                   "Розмістіть банер про спільну покупку цих товарів на головній сторінці сайту.")

# The prompt templates (placeholders in order of use).
SEGMENT_PROMPT = """
    Ти — провідний стратег з електронної комерції. Ніша бізнесу: "%s".
    Ти аналізуєш результати кластеризації.

    Дані сегмента клієнтів:
    - Назва кластера: %s
    - Давність покупки: %s днів
    - Частота замовлень: %s
    - Середній чек: %s грн.

    Завдання:
    Напиши маркетингові поради для цього сегмента.

    Суворі правила оформлення відповіді (порушення критичне):
    1. Текст має складатися рівно з двох речень. Одне речення описує одну пораду. 
    2. Не використовуй жодних списків, маркерів, цифр чи абзаців. Текст повинен йти суцільним рядком із двох речень.
    3. Повністю заборонено використовувати будь-які англійські слова чи абревіатури.
    4. Категорично заборонено використовувати жирний шрифт або символи зірочок. Текст має бути звичайним.
    """

BUNDLE_PROMPT = """
    Ти — провідний експерт із мерчандайзингу. Ніша бізнесу: "%s".
    Ти аналізуєш асоціативні правила.

    Дані аналізу: 
    Користувачі, які купують товар "%s", також купують товар "%s" із впевненістю %s%%.

    Завдання:
    Напиши бізнес-стратегії монетизації цього зв'язку.

    Суворі правила оформлення відповіді (порушення критичне):
    1. Текст має складатися рівно з двох речень. Одне речення описує одну стратегію.
    2. Не використовуй жодних списків, маркерів, цифр чи абзаців. Текст повинен йти суцільним рядком із двох речень.
    3. Повністю заборонено використовувати англійські слова чи професійний жаргон.
    4. Категорично заборонено використовувати жирний шрифт або символи зірочок. Текст має бути звичайним.
    """


def number_text(col) -> Column:
    """A value rounded to 2 decimals written like a Python float (``12.0``, ``12.5``)."""
    fixed2 = F.round(_c(col), 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(fixed2, r"(\.\d)0$", "$1")


def segment_advice_text(name) -> Column:
    """Premium advice if the name holds 'Champions' or '1', win-back if 'Risk' or '3'."""
    n = _c(name)
    return (F.when(n.contains("Champions") | n.contains("1"), F.lit(ADVICE_TOP))
             .when(n.contains("Risk") | n.contains("3"), F.lit(ADVICE_RISK))
             .otherwise(F.lit(ADVICE_DEFAULT)))


def segment_advice(segments: DataFrame, name_col: str = "cluster_name",
                   business_type: str = "") -> DataFrame:
    """H6 + H9: one fallback advice row per (tenant, segment name, business type)."""
    out = segments.withColumn("business_type", F.lit(business_type)).withColumn(
        "advice", segment_advice_text(name_col)).withColumn("is_fallback", F.lit(True))
    return dedupe_advice(out, ["tenant_id", name_col, "business_type"])


def bundle_advice(pairs: DataFrame, item_a: str = "item_a", item_b: str = "item_b") -> DataFrame:
    """H7 + H9: bundle text per (item A, item B, confidence)."""
    out = pairs.withColumn("advice", F.format_string(BUNDLE_TEMPLATE, F.col(item_a), F.col(item_b)))
    return dedupe_advice(out.withColumn("is_fallback", F.lit(True)),
                         ["tenant_id", item_a, item_b, "confidence"])


def segment_prompt(segments: DataFrame, business_type: str, name_col: str = "cluster_name") -> DataFrame:
    """H8: prompt text for a segment (recency, frequency, monetary as Python prints them)."""
    return segments.withColumn("prompt", F.format_string(
        SEGMENT_PROMPT, F.lit(business_type), F.col(name_col), number_text("recency"),
        number_text("frequency"), number_text("monetary")))


def bundle_prompt(pairs: DataFrame, business_type: str, item_a: str = "item_a",
                  item_b: str = "item_b", confidence_pct: str = "confidence_pct") -> DataFrame:
    return pairs.withColumn("prompt", F.format_string(
        BUNDLE_PROMPT, F.lit(business_type), F.col(item_a), F.col(item_b), F.col(confidence_pct)))


def clean_text(df: DataFrame, col: str, out: str = "clean_text") -> DataFrame:
    """F7 applied to a column."""
    return df.withColumn(out, clean_advice(col))


def dedupe_advice(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H9: one row per key (the reference caches advice by these keys)."""
    return df.dropDuplicates(list(keys))
