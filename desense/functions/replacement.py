"""What a sensitive value is replaced with, its labels, and the built-in policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display labels, fixed replacements, school words.
LABELS = {
    "PERSON": "姓名", "ORGANIZATION": "机构", "LOCATION": "地点", "GPE": "地点", "PHONE": "手机号",
    "EMAIL": "邮箱", "ID_CARD": "身份证", "BANK_CARD": "银行卡", "ADDRESS": "地址",
}
FIXED = {"PERSON": "某人", "LOCATION": "某地点", "GPE": "某地点", "ADDRESS": "某地址", "EMAIL": "***@***"}
SCHOOL_WORDS = ["大学", "学院", "学校", "中学", "小学"]
SCHOOL, COMPANY, GENERIC = "某学校", "某公司", "已脱敏"
#: Type, behaviour and example originals of the built-in policies.
BUILT_IN = [
    ("PERSON", "替换为“某人”", ["张三"]),
    ("ORGANIZATION", "学校替换为“某学校”，其余替换为“某公司”", ["北京大学", "某科技有限公司"]),
    ("LOCATION", "替换为“某地点”", ["北京市"]),
    ("GPE", "替换为“某地点”", ["北京市"]),
    ("ADDRESS", "替换为“某地址”", ["北京市朝阳区某街道"]),
    ("PHONE", "11 位号码保留前三后四，其余替换为“已脱敏”", ["13812345678", "01088888888"]),
    ("EMAIL", "替换为“***@***”", ["name@example.com"]),
    ("ID_CARD", "替换为“已脱敏”", ["110101199001011234"]),
    ("BANK_CARD", "替换为“已脱敏”", ["6222021234567890123"]),
]


def type_label(entity_type: Column) -> Column:
    """Display label; an unknown type is its own."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[entity_type], entity_type)


def default_replacement(entity_type: Column, value: Column) -> Column:
    school = F.lit(False)
    for w in SCHOOL_WORDS:
        school = school | value.contains(w)
    phone = F.concat(F.left(value, F.lit(3)), F.lit("****"), F.substring(value, 8, 4))
    out = F.when((entity_type == "PHONE") & (F.length(value) == 11), phone)
    out = out.when(entity_type == "ORGANIZATION", F.when(school, SCHOOL).otherwise(COMPANY))
    for name, text in FIXED.items():
        out = out.when(entity_type == name, text)
    return out.otherwise(GENERIC)


def default_of(entity_type: str | None, value: str) -> str:
    """The same of one value inside a task."""
    if entity_type == "PHONE" and len(value) == 11:
        return f"{value[:3]}****{value[7:11]}"
    if entity_type == "ORGANIZATION":
        return SCHOOL if any(w in value for w in SCHOOL_WORDS) else COMPANY
    return FIXED.get(entity_type, GENERIC)


#: The same as SQL, for the oracle.
DEFAULT_SQL = (
    "CASE WHEN entity_type = 'PHONE' AND length(value) = 11 THEN left(value, 3) || '****' || substring(value, 8, 4) "
    + f"WHEN entity_type = 'ORGANIZATION' THEN CASE WHEN {' OR '.join(f"contains(value, '{w}')" for w in SCHOOL_WORDS)} THEN '{SCHOOL}' ELSE '{COMPANY}' END "
    + " ".join(f"WHEN entity_type = '{k}' THEN '{v}'" for k, v in FIXED.items())
    + f" ELSE '{GENERIC}' END"
)
LABEL_SQL = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE entity_type END"
