"""Screening: personal data, prompt injection, guardrails, emotions and escalation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize_answer, normalize_question

# Patterns and placeholders in the order in which they apply. Group 1, where there is one, is context that stays.
PII = (
    (r"(?<!\d)1[3-9]\d{9}(?!\d)", "【手机号】"),
    (r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "【邮箱】"),
    (r"(?<!\d)\d{17}[\dXx](?!\d)", "【身份证号】"),
    (r"(卡[号码：: ]{0,2})\d{13,19}", "$1【银行卡号】"),
    (r"(订单[号码：: ]{0,2}|单号[：: ]|快递[单号：: ]{0,2}|物流[单号：: ]{0,2}|运单[单号：: ]{0,2})\d{8,}", "$1【单号】"),
    (r"(?<![a-zA-Z0-9_])((?:微信|vx|wx|qq)[号码:：\s]{0,3})(?=[a-zA-Z0-9_]*\d)[a-zA-Z0-9_]{5,20}", "$1【联系方式】"),
    (r"(?<!\d)\d{12,}(?!\d)", "【单号】"),
)
IGNORE_HINTS = (
    "忽略之前", "忽略前面", "忽略以上", "忘记之前", "不要理会", "ignore previous", "ignore all previous", "disregard previous",
    "忽略政策", "忽略安全", "忽略一切", "忽略所有",
)
ESCALATION_HINTS = (
    "管理员指令", "内部工单", "内部接口", "内部测试", "平台安全组", "dev_mode", "hidden_tools", "系统指令", "系统提示词", "你的提示词",
    "解锁所有", "超级管理员", "越权", "假装你是", "假装没看到", "以上对话作废", "参数定义", "篡改", "环境变量", "session 文件", "不要转人工",
)
ROLE_MARKER = r"(?im)^\s*(system|user|assistant)\s*[:：]"

COMPLAINTS = ("投诉", "举报", "消协", "工商局", "起诉", "曝光", "赔偿", "告你们", "态度差", "敷衍", "欺诈")
PURCHASES = ("我要买", "买一个", "拍下", "立即购买", "帮我下单", "直接买")
CONSULTS = ("多少钱", "价格", "批发", "介绍", "推荐", "有货吗", "怎么卖")
EXTREME = ("起诉", "法院", "律师", "报警", "消协", "消费者协会", "工商局", "12315", "举报", "曝光", "媒体", "记者", "诈骗", "欺诈", "假货", "违法")
ANGRY = (
    "投诉", "赔偿", "告你们", "骗子", "骗人", "欺骗", "耍人", "气死", "生气", "愤怒", "火大", "恼火", "太差", "很差", "差劲", "垃圾",
    "恶心", "过分", "欺负", "差评", "骂人", "什么态度", "态度差", "敷衍",
)
DISSATISFIED = (
    "不满", "失望", "无语", "离谱", "烦人", "烦死", "急死", "崩溃", "受不了", "不开心", "糟糕", "气人", "恶劣", "冷漠", "推诿", "没人理",
    "不耐烦", "太烂", "烂透", "坑人", "被坑", "怎么回事", "搞什么", "什么意思", "到底", "还没", "没收到", "没发货", "没解决", "没动静",
    "等了", "催", "太慢", "很慢", "退钱",
)
BLOCKED_TERMS = ("私下转账", "支付宝转账", "微信转账", "银行卡密码")
CATEGORIES = (
    ("offsite_payment", r"私下(?:转账|付款|交易)|(?:支付|转)到(?:我|你|您)?的?(?:微信|支付宝|银行卡)|(?:转|打)(?:给)?(?:我|你|您)(?:的)?(?:微信|支付宝|银行卡|收款码|付款码)|(?:微信|支付宝|银行卡)(?:转账|付款|打款)|银行卡密码|发(?:我|你|您)?(?:的)?(?:收款码|付款码|银行卡号)"),
    ("external_contact", r"(?:加|留|给|发)(?:一下)?(?:我|你|您)?(?:的)?(?:私人)?(?:微信|weixin|QQ|qq|whatsapp|whatsApp)|(?:加|扫)(?:个)?(?:微信|二维码)|扫码加|私聊|私下联系|站外(?:联系|沟通|交易)|线下(?:交易|付款)|(?:我|你|您)的(?:手机号|电话|微信号)是"),
    ("competitor_steering", r"(?:去|到|上|在)(?:淘宝|京东|拼多多|天猫|抖音|亚马逊|唯品会)(?:买|下单|看看|搜|找)|(?:淘宝|京东|拼多多|天猫|抖音|亚马逊|唯品会)(?:更|比较|要)(?:便宜|划算|靠谱)|别(?:在)?(?:我们|咱们)(?:这|这里)?(?:买|下单)|别(?:在)?(?:这|本平台)(?:买|下单)"),
    ("abuse", r"傻[逼b]|滚(?:蛋|出去)|废物|去死|神经病|脑子有病|白痴|蠢货|(?:妈的|他妈的|靠你)|垃圾(?:平台|东西|客服)|没长(?:眼|脑子)|(?:你|您)(?:是不是)?有病"),
)
NEGATION = "不|勿|别|禁止|切勿|严禁|拒绝|不支持|不得|避免"
NEGATION_WINDOW = 8
TAINTED_TEXT = "（该片段疑似含指令注入，已拦截）"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def pii_mask(text: Column) -> Column:
    """Personal data give way to placeholders, one pattern after the other."""
    for pattern, placeholder in PII:
        text = F.regexp_replace(text, f"(?U){pattern}" if r"\w" in pattern else pattern, placeholder)
    return text


def has_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(f"(?U){p}" if r"\w" in p else p) for p, _ in PII))


#: Phone numbers in a memory (also within longer ones) and what stands for them, and words of a lasting instruction, which free memories must not hold.
MEMORY_PHONE, MEMORY_PLACEHOLDER = r"1[3-9]\d{9}", "[已脱敏号码]"
MEMORY_INSTRUCTIONS = ("以后都", "今后都", "今后一律", "以后一律", "永远都要", "忽略", "无视", "不要遵守", "不得违反", "必须服从")


def mask_phone(text: Column) -> Column:
    """Only phone numbers, for memory texts."""
    return F.regexp_replace(text, MEMORY_PHONE, MEMORY_PLACEHOLDER)


def memory_injection(fact_key: Column, content: Column) -> Column:
    """Whether a memory must not be kept: an injection, or a lasting instruction under a free key (custom.…)."""
    return has_injection(content) | (fact_key.startswith("custom.") & _any(F.lower(content), MEMORY_INSTRUCTIONS))


def has_injection(text: Column) -> Column:
    """A role marker at a line's start, a hint to ignore or escalate, or a code fence."""
    low = F.lower(text)
    return text.rlike(ROLE_MARKER) | _any(low, IGNORE_HINTS) | _any(low, ESCALATION_HINTS) | text.contains("```")


def guard_input(text: Column) -> Column:
    """block an injection, mask personal data, else ok."""
    return F.when(has_injection(text), "block").when(pii_mask(text) != text, "mask").otherwise("ok")


def _unnegated(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs without a whole negation among the few characters (line ends too) before it."""
    before = "|".join(rf"{word}[\s\S]{{0,{NEGATION_WINDOW - len(word)}}}" for word in NEGATION.split("|"))
    return text.rlike(rf"(?<!{before})(?:{pattern})")


def guard_output(text: Column, emotion: Column) -> Column:
    """Reason to block a reply, or null: a blocked term, or a category; abuse counts only for angry users."""
    low = F.lower(text)
    out = reduce(lambda acc, t: acc.when(_unnegated(low, t.lower()), f"term:{t}"), BLOCKED_TERMS[1:], F.when(_unnegated(low, BLOCKED_TERMS[0]), f"term:{BLOCKED_TERMS[0]}"))
    for name, pattern in CATEGORIES:
        hit = _unnegated(text, pattern)
        out = out.when(hit & emotion.isin("angry", "extreme") if name == "abuse" else hit, f"category:{name}")
    return out


def fence_taint(text: Column, matched: Column) -> Column:
    """A struct: tainted, and the text, or a placeholder if it or the matched part holds an injection."""
    tainted = has_injection(text) | F.coalesce(has_injection(matched), F.lit(False))
    return F.struct(tainted.alias("tainted"), F.when(tainted, TAINTED_TEXT).otherwise(text).alias("text"))


def emotion_level(text: Column) -> Column:
    return F.when(_any(text, EXTREME), "extreme").when(_any(text, ANGRY), "angry").when(_any(text, DISSATISFIED), "dissatisfied").otherwise("neutral")


def business_escalation(text: Column) -> Column:
    """complaint, or purchase unless it only asks, or null."""
    return F.when(_any(text, COMPLAINTS), "complaint").when(_any(text, PURCHASES) & ~_any(text, CONSULTS), "purchase")


def skip_reason(confidence: Column, requires_human: Column, n_sources: Column, question: Column, answer: Column) -> Column:
    """Why a question and answer isn't mined, the first reason that holds, or null."""
    return (
        F.when(confidence < 0.8, "low_confidence").when(requires_human, "requires_human").when(n_sources == 0, "no_sources")
        .when((F.length(question) < 4) | (F.length(answer) < 20), "short").when(has_pii(question) | has_pii(answer) | has_injection(question) | has_injection(answer), "sensitive")
    )


def candidate_rejection(question: Column, answer: Column, cited: Column, agent_ids: Column) -> Column:
    """Why a candidate of a human conversation is rejected, the first reason that holds, or null.

    invalid_format: question or answer can't be normalised; no_evidence: it cites no message; invalid_evidence: it cites one that is not the agent's
    (``agent_ids``; nulls in either list are no messages); sensitive: personal data or an injection in the normalised texts.
    """
    q, a = normalize_question(question), normalize_answer(answer)
    sample = F.concat_ws("\n", q, a)
    none = F.array().cast("array<string>")
    ids, agents = F.coalesce(cited, none), F.array_compact(F.coalesce(agent_ids, none))
    return (
        F.when((q == "") | (a == ""), "invalid_format").when(F.size(ids) == 0, "no_evidence")
        .when(F.exists(ids, lambda i: i.isNull()) | (F.size(F.array_except(ids, agents)) > 0), "invalid_evidence").when(has_pii(sample) | has_injection(sample), "sensitive")
    )
