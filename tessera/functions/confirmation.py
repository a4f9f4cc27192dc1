"""Whether a message confirms, cancels or leaves open a pending write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases of each kind of statement.
CANCEL = (
    r"取消(?:退款|申请)?|不要了|不退了|先不退|暂不退|不用了|算了|别退|撤回(?:退款|申请)?|撤销(?:退款|申请)?|放弃(?:退款|申请)?|不办了|拒绝退款|"
    r"(?:不要|不用|不想|不再|无需|不需要)\s*(?:这笔|该笔|本次|此次)?\s*(?:退款|退货|退钱|申请)|(?:退款|退货|退钱|申请退款).{0,6}(?:不要|不用|不想|不再|无需|不需要)"
)
NEGATED_CANCEL = r"(?:不|不要|别|无需|不用|不能|暂不)\s*(?:要\s*)?取消(?:退款|申请)?"
NEGATED_CONFIRM = r"(?:不|没|未|不能|无法|暂时不能|暂不|还没|不想|不要|拒绝)\s*(?:确认|同意|确定|批准|执行|提交|撤回|撤销|退(?:款|货|钱)?)"
CONFIRM_REFUND = r"(?:确认|同意|确定|批准|执行|提交)\s*(?:一下|下|要\s*)?(?:这笔|该笔|本次|此次|这个|该)?\s*(?:退款申请|申请退款|退款|退货|退钱)"
CONFIRM_WITHDRAW = r"(?:确认|同意|确定|批准|执行)\s*(?:一下|下)?\s*(?:撤回|撤销)\s*(?:退款申请|申请|退款)?"
CONFIRM_ORDER = r"(?:确认|同意|确定|批准|执行|提交)\s*(?:一下|下|要\s*)?(?:订单|这笔订单|该订单)?\s*ORD-[A-Za-z0-9\-]+"
AFFIRM = r"(?:没错|就是这样|就这么办|退吧|退了吧|是的|对|可以退|给我退|好)"
AFFIRM_REFUND = rf"^{AFFIRM}\s*[，,]?\s*{AFFIRM}?\s*(?:这笔|该笔|本次|此次)?\s*(?:退款|退货|退钱)?[。！~.!\s]*$"
CONFIRM_BARE = r"(?i)^(?:我\s*)?(?:确认|同意|确定|没错|就是这样|就这么办|退吧|执行|是的|对[，,]?|可以退|给我退)(?:\s*(?:以上|这笔|该笔|本次|此次))?[。！~.!\s]*$"
CONFIRM_WEAK = r"(?i)^(?:好的?|嗯+|可以|行|ok|yes|对|是|嗯嗯|要|退|好呀|好嘞|的确|当然)[。！~.!\s]*$"
QUESTION = r"(?:吗|么|如何|怎么|怎样|是否|可否|能否|要不要|为什么|[？?])"
APPLICATION_TOOL = "submit_refund_application"


def mentioned_order(text: Column) -> Column:
    """An ORD- number; else one named after an order or refund; else a word of six or more with a digit."""
    named = F.regexp_extract(text, r"(?:订单|退款)\s*(?:号|ID|id)?\s*[:：#]?\s*([A-Za-z][A-Za-z0-9\-]*\d[A-Za-z0-9\-]*)", 1)
    loose = F.regexp_extract(text, r"(?=[A-Za-z0-9\-]*\d)[A-Za-z0-9][A-Za-z0-9\-]{5,}", 0)
    found = F.nullif(F.regexp_extract(text, r"ORD-[A-Za-z0-9\-]+", 0), F.lit(""))
    return F.coalesce(found, F.nullif(named, F.lit("")), loose)


def confirmation(text: Column, tool: Column, order_id: Column, application_id: Column) -> Column:
    """confirm, cancel, ambiguous or none, for a message and the one pending write (a null tool: there is none)."""
    said = F.trim(F.coalesce(text, F.lit("")))
    application, order = F.regexp_extract(said, r"RA-[A-Za-z0-9\-]+", 0), mentioned_order(said)
    other = F.when(application != "", ~F.coalesce(application == application_id, F.lit(False))).when(order != "", ~F.coalesce(order == order_id, F.lit(False))).otherwise(False)
    denied, asked = said.rlike(NEGATED_CONFIRM), said.rlike(QUESTION)
    agreed = said.rlike(CONFIRM_REFUND) | said.rlike(CONFIRM_ORDER) | said.rlike(AFFIRM_REFUND) | said.rlike(CONFIRM_BARE) | said.rlike(CONFIRM_WEAK)
    names_it = F.coalesce((application_id != "") & F.contains(said, application_id), F.lit(False))
    return (
        F.when(tool.isNull(), "none").when(other, "ambiguous").when(~denied & ~asked & said.rlike(CONFIRM_WITHDRAW), "confirm")
        .when(said.rlike(CANCEL) & ~said.rlike(NEGATED_CANCEL), "cancel").when(denied | asked, "ambiguous")
        .when(tool != APPLICATION_TOOL, F.when(names_it, "confirm").otherwise("ambiguous")).when(agreed, "confirm").otherwise("ambiguous")
    )
