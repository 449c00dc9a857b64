"""Entity classes and detector rules, as data.

Fixed values: codes, tiers, token families, labels and number formats have to be as they are
for results to agree with the documents' existing tokens and audits.
"""

from __future__ import annotations

from dataclasses import dataclass

#: code -> (tier, token family if not the code itself)
ENTITIES = {
    "CN_ID": (1, None), "USCC": (1, "ORG_REG"), "CN_MOBILE": (1, None), "BANK_CARD": (1, "BANK_ACCOUNT"), "CN_TAX_ID": (1, "ORG_REG"),
    "EMAIL": (1, None), "PASSPORT": (1, None), "HK_MO_PERMIT": (1, None), "TW_PERMIT": (1, None), "HK_ID": (1, None), "SG_NRIC": (1, None),
    "MY_ID": (1, None), "MILITARY_ID": (1, None), "TH_TAXID": (1, None), "TH_JURISTIC": (1, None), "PERSON": (2, None), "ORG": (2, None),
    "LANDLINE": (2, None), "ADDRESS": (2, None), "CASE_NO": (3, None), "REG_NO": (3, None), "LOCATION": (3, None), "LAWYER_NO": (3, None),
    "PLATE": (3, None), "LEGACY_ID": (3, None), "BANK_ACCOUNT": (4, None), "WECHAT": (4, None), "CREDENTIAL": (4, None), "IP": (4, None),
}
KEEPS_CASE = ("WECHAT", "EMAIL", "CREDENTIAL")
REMOVED = ("CREDENTIAL",)
SOURCES = ("context", "checksum", "pattern", "model")  # by preference

#: Characters that people put between the groups of a number.
SEPARATORS = " \t-－–—　·"
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """One detector.

    ``mode``: ``plain`` (hits of ``pattern``), ``group`` (its first group, whose right side is
    no digit), ``label`` (for each hit of ``label``, the first hit of ``pattern`` behind it) or
    ``spaced`` (hits of ``pattern`` with separators allowed between characters).
    ``bounded``: no ASCII letter or digit on either side.  ``check`` names a further test.
    ``needs``: literals; a text without any of them has no hit and is not searched.
    ``digits``: so many digits, with no more than separators between, are in every hit.
    """

    code: str
    mode: str
    pattern: str
    source: str
    label: str = ""
    bounded: bool = True
    check: str = ""
    unclaimed: bool = False
    needs: tuple[str, ...] = ()
    digits: int = 0


_GAP = r"[\s:：|()（）\[\]【】`]*"
_S = "[" + SEPARATORS.replace("-", r"\-") + "]*"
_D = "[0-9０-９]"


def spaced(atom: str, least: int, most: int, last: str = "") -> str:
    """``atom`` repeated, with separators in between, and one ``last``."""
    tail = f"{_S}{last}" if last else ""
    return f"{atom}(?:{_S}{atom}){{{least - 1},{most - 1}}}{tail}"


CODE = "[0-9A-HJ-NPQRTUWXY０-９Ａ-ＨＪ-ＮＰＱＲＴＵＷＸＹ]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HAN = r"[一-鿿]"
_HAN_DIGIT = r"[一-鿿0-9]"

#: In the order in which a span is claimed.
RULES = (
    Rule("TH_JURISTIC", "group", rf"(?:Juristic\s*ID|法人登记号|法人登記號)(?:\s*No\.?)?{_GAP}([0-9]{{13}})", "context", needs=("Juristic", "法人登记号", "法人登記號")),
    Rule("TH_TAXID", "group", rf"(?:Tax\s*ID|纳税人识别号)(?:\s*No\.?)?{_GAP}([0-9]{{13}})", "context", needs=("Tax", "纳税人识别号")),
    Rule("TH_TAXID", "group", rf"(?:泰国(?:企业)?(?:纳税人识别号|识别号|税号)|泰国(?:企業)?(?:納稅人識別號|識別號|稅號)){_GAP}([0-9]{{13}})", "context", needs=("泰国",)),
    Rule("MILITARY_ID", "plain", "军字第[0-9]{6,10}号", "context", bounded=False, needs=("军字第",)),
    Rule("PASSPORT", "label", "[A-HJ-NP-Z][A-HJ-NP-Z]?[0-9]{7,8}", "context", label=r"护照(?:号码?)?[:：\s]*", unclaimed=True, needs=("护照",)),
    Rule("CN_ID", "spaced", spaced(_D, 17, 17, "[0-9０-９XxＸｘ]"), "", check="resident_id", digits=17),
    Rule("USCC", "spaced", spaced(CODE, 18, 18), "", check="credit_code", unclaimed=True),
    Rule("CN_MOBILE", "spaced", f"(?:[8８]{_S}[6６]{_S})?[1１]{_S}[3-9３-９](?:{_S}{_D}){{9}}", "checksum", unclaimed=True, digits=11),
    Rule("BANK_CARD", "spaced", spaced(_D, 12, 19), "", check="card", unclaimed=True, digits=12),
    Rule("LANDLINE", "plain", "0(?:10|2[1-9]|[3-9][0-9]{2})-?[0-9]{7,8}", "pattern", digits=10),
    Rule("IP", "plain", rf"(?:{_OCTET}\.){{3}}{_OCTET}", "pattern", check="no_more_octets", needs=(".",)),
    Rule("EMAIL", "plain", r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "pattern", bounded=False, needs=("@",)),
    Rule("PASSPORT", "plain", "E[A-HJ-NPZ][0-9]{7}|E[0-9]{8}", "pattern", digits=7),
    Rule("HK_MO_PERMIT", "plain", "[HM][0-9]{10}", "pattern", digits=10),
    Rule("HK_MO_PERMIT", "label", "(?:HK|M)[0-9]{7}", "context", label=r"(?:(?:香港)?入境许可(?:证)?|(?:澳门)?非本地劳工证|劳工证)[:： \t　]*", needs=("入境许可", "劳工证")),
    Rule("ADDRESS", "plain", rf"(?:{_HAN}{{2,8}}(?:省|自治区|特别行政区))?(?:{_HAN}{{2,10}}(?:市|自治州)){_HAN_DIGIT}{{0,20}}?(?:{_HAN}{{2,10}}(?:区|县|市))?{_HAN_DIGIT}{{0,24}}?(?:路|街|道|巷|弄|大道){_HAN_DIGIT}{{0,20}}?[0-9]{{1,5}}号", "pattern", needs=("号",)),
    Rule("HK_MO_PERMIT", "plain", r"(?U)\b[1-9][0-9]{6}\([0-9]\)", "pattern", needs=("(",), digits=7),
    Rule("PLATE", "plain", "澳[A-Za-z][0-9]{4}", "pattern", needs=("澳",)),
    Rule("CN_TAX_ID", "label", "[0-9]{10}(?:-[0-9]{3})?", "context", label=r"(?:越南)?(?:MST|Mã\s*số\s*thuế|税号)\s*[:：]?\s*", needs=("MST", "Mã", "税号")),
    Rule("CN_TAX_ID", "label", "[0-9]{3}-[0-9]{3}-[0-9]{3}(?:-[0-9]{3})?", "context", label=r"(?:菲律宾)?(?:TIN|Taxpayer\s*Identification\s*Number)\s*[:：]?\s*", needs=("TIN", "Taxpayer")),
    Rule("CN_TAX_ID", "label", r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}\.[0-9]-[0-9]{3}\.[0-9]{3}", "context", label=r"(?:印尼)?NPWP\s*[:：]?\s*", needs=("NPWP",)),
    Rule("HK_MO_PERMIT", "plain", "C[0-9]{8}", "pattern", digits=8),
    Rule("HK_MO_PERMIT", "label", "[CHM][0-9]{7,10}", "context", label=r"港澳(?:通行证|居民来往内地通行证)(?:号码|编号)?[:：]?\s*", needs=("港澳",)),
    Rule("TW_PERMIT", "label", "[0-9]{8}(?:[0-9]{2})?", "pattern", label="(?:台胞证|台湾(?:居民来往大陆)?通行证)(?:号码)?[:：]?", needs=("台胞证", "通行证")),
    Rule("LEGACY_ID", "label", "[1-9][0-9]{14}", "context", label=r"(?:旧行?身份证(?:号码?)?|身份证(?:号码?)?|证件号码?)[:：\s]*", needs=("身份证", "证件号")),
    Rule("LAWYER_NO", "label", "[0-9]{17}", "context", label=r"(?:律师)?执业证(?:号码?)?[:：\s]*", needs=("执业证",)),
    Rule("PLATE", "plain", "[京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新][A-Za-z][A-Za-z0-9]{5,6}", "pattern", check="plate", needs=tuple("京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新")),
    Rule("CN_TAX_ID", "label", "[0-9A-Z]{15,20}", "context", label=r"纳税人识别号(?:码)?[:：\s]*", check="some_digit", needs=("纳税人识别号",)),
    Rule("BANK_ACCOUNT", "label", "[0-9][0-9 －–—\\-]{6,40}[0-9]", "context", label=r"(?:基本户|一般户|开户行|开户银行)?(?:银行)?(?:账号|帐号|账户|帐户)(?:号码)?[:：\s]*", check="account", needs=("账", "帐")),
    Rule("WECHAT", "group", r"(?:微信号?|WeChat\s*ID)[:：\s]*([A-Za-z][A-Za-z0-9_\-]{5,19})", "context", check="both_sides", needs=("微信", "WeChat")),
    Rule("HK_ID", "plain", r"[A-Z]{1,2}[0-9]{6}\([0-9A]\)", "pattern", needs=("(",), digits=6),
    Rule("SG_NRIC", "plain", "[STFGM][0-9]{7}[A-Z]", "pattern", digits=7),
    Rule("MY_ID", "plain", "[0-9]{6}-[0-9]{2}-[0-9]{4}", "pattern", check="malaysian", digits=12),
)
