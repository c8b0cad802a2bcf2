"""Detection rules as data, and immutable rule sets."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions import validators as v
from veilspark.plans import patterns


@dataclass(frozen=True)
class Rule:
    """group 1 is the tail of the pattern; fold: case-insensitive."""

    rule_id: str
    category: str
    priority: int
    pattern: str
    group: int = 0
    fold: bool = False
    valid: v.Validator = v.always

    @property
    def regex(self) -> str:
        return f"(?iu){self.pattern}" if self.fold else self.pattern


# Fragments of the patterns of labelled fields.
FIELD = "[：:=\\s]{0,5}"
SEPARATOR = "[：:=#\\s]{0,8}"
IDENTIFIER = "[A-Z0-9][A-Z0-9./_\\- ]{2,49}[A-Z0-9]"
ACCOUNT = "[A-Z0-9](?:[ A-Z0-9-]{4,38})[A-Z0-9]"
HAN_VALUE = "[^，。；;\\r\\n]{2,100}"
PERSON = "[\\p{IsHan}·]{2,8}"
MONEY = "(?:人民币|RMB|￥|¥)?[0-9][0-9,]*(?:\\.\\d{1,2})?"


def labelled(rule_id: str, category: str, priority: int, labels: str, value: str, valid: v.Validator = v.always) -> Rule:
    """A rule for a value that follows one of the labels."""
    return Rule(rule_id, category, priority, f"(?:{labels}){SEPARATOR}({value})", 1, True, valid)


# Identifiers, categories, priorities and patterns of the built-in rules, in their order.
BUILT_IN = (
    Rule("CN_RESIDENT_ID", "identity", 100, "(?<![0-9A-Za-z])[1-9]\\d{5}(?:18|19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[0-9Xx](?![0-9A-Za-z])", valid=v.cn_resident_id),
    Rule("CN_UNIFIED_SOCIAL_CREDIT_CODE", "organization", 98, "(?<![0-9A-Z])[0-9A-HJ-NPQRTUWXY]{18}(?![0-9A-Z])", valid=v.uscc),
    Rule("BANK_CARD_NUMBER", "financial", 96, "(?<!\\d)(?:\\d[ -]?){12,18}\\d(?!\\d)", valid=v.luhn),
    Rule("EMAIL_ADDRESS", "contact_location", 94, "(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,63}(?![A-Z0-9._%+-])", fold=True),
    Rule("CN_MOBILE_PHONE", "contact_location", 92, "(?<!\\d)(?:\\+?86[- ]?)?1[3-9]\\d{9}(?!\\d)"),
    Rule("IPV4_ADDRESS", "network_security", 90, "(?<![0-9.])(?:\\d{1,3}\\.){3}\\d{1,3}(?![0-9.])", valid=v.ipv4),
    Rule("MAC_ADDRESS", "network_security", 90, "(?<![0-9A-F])(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}(?![0-9A-F])", fold=True),
    Rule("VEHICLE_IDENTIFICATION_NUMBER", "vehicle_property", 88, "(?<![A-Z0-9])[A-HJ-NPR-Z0-9]{17}(?![A-Z0-9])", fold=True, valid=v.vin),
    Rule("CN_LICENSE_PLATE", "vehicle_property", 87, "(?<![A-Z0-9])[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-HJ-NP-Z0-9]{5,6}(?![A-Z0-9])", fold=True),
    Rule("CN_JUDICIAL_CASE_NUMBER", "legal_case", 86, "[（(]\\d{4}[）)][\\p{IsHan}]{1,4}\\d{1,6}[\\p{IsHan}]{1,4}\\d+号"),
    Rule("PASSPORT_NUMBER", "identity", 85, "(?<![A-Z0-9])(?:[EG]\\d{8}|[A-Z]\\d{7,8})(?![A-Z0-9])", fold=True, valid=v.keywords("护照", "passport")),
    Rule("URL", "network_security", 82, "https?://[^\\s<>()\\[\\]{}\"'，。；;]+", fold=True),
    Rule("TELEPHONE_NUMBER", "contact_location", 80, "(?<!\\d)(?:0\\d{2,3}[- ]?)?\\d{7,8}(?:[-转 ]\\d{1,6})?(?!\\d)", valid=v.keywords("电话", "传真", "联系方式", "tel")),
    Rule("POSTAL_CODE", "contact_location", 76, "(?<!\\d)[1-9]\\d{5}(?!\\d)", valid=v.keywords("邮编", "邮政编码")),
    Rule("INVOICE_CODE_NUMBER", "financial", 75, "(?<!\\d)\\d{8,20}(?!\\d)", valid=v.keywords("发票代码", "发票号码", "发票号")),
    Rule("CONTRACT_NUMBER", "business", 74, "(?:合同编号|合同号)[：:\\s]*([A-Z0-9][A-Z0-9_./-]{3,40})", 1, True),
    Rule("QQ_ID", "contact_location", 72, "(?:QQ|qq)[号：:\\s]*([1-9]\\d{4,11})", 1),
    Rule("WECHAT_ID", "contact_location", 72, "(?:微信号|微信|WeChat)[：:\\s]*([A-Z][-_A-Z0-9]{5,19})", 1, True),
    Rule("ARABIC_NUMERAL_AMOUNT", "financial", 70, "(?:人民币|RMB|￥|¥)[：:\\s]*([0-9][0-9,]*(?:\\.\\d{1,2})?)", 1, True),
    Rule("CN_UPPERCASE_AMOUNT", "financial", 69, "(?:人民币|金额|价款)[：:\\s]*([零壹贰叁肆伍陆柒捌玖拾佰仟万亿兆圆元角分整]{2,40})", 1),
    Rule("STOCK_CODE", "financial", 68, "(?:股票代码|证券代码|股票)[：:\\s]*((?:[0368]\\d{5}|[A-Z]{1,5})(?:\\.(?:SH|SZ|BJ|HK|US))?)", 1, True),
    Rule("HK_MACAO_TAIWAN_PERMIT", "identity", 67, "(?<![A-Z0-9])[HMLWC]\\s?\\d{8,10}(?![A-Z0-9])", fold=True, valid=v.keywords("通行证", "居住证", "回乡证", "台胞证")),
    Rule("LEGACY_BUSINESS_REGISTRATION", "organization", 66, "(?:工商注册号|营业执照注册号|企业注册号|注册号)[：:\\s]*([0-9][0-9 -]{13,20}[0-9])", 1),
    Rule("REAL_ESTATE_CERTIFICATE", "property", 65, "(?:不动产权证书号|不动产权证号|房产证号|产权证号)[：:\\s]*([^，。；;\\r\\n]{4,50})", 1),
    Rule("CN_DATE", "quasi_identifier", 60, "(?<!\\d)(?:19|20)\\d{2}[年./-](?:0?[1-9]|1[0-2])[月./-](?:0?[1-9]|[12]\\d|3[01])日?(?!\\d)"),
    Rule("CN_PERSON_NAME", "identity", 58, "(?:姓名|当事人|申请人|原告|被告人?|证人)[：:\\s]{0,3}([\\p{IsHan}·]{2,8})", 1),
    Rule("POSTAL_ADDRESS", "contact_location", 90, "(?:户籍地址|户籍地|联系地址|地址|住址|住所)[：:\\s]{0,3}([^，。；;\\r\\n]{6,80})", 1),
    Rule("ORGANIZATION_NAME", "organization", 54, "(?:单位|工作单位|所属机构|律所)[：:\\s]{0,3}([^，。；;\\r\\n]{3,60})", 1),
    Rule("IBAN", "financial", 99, "(?<![A-Z0-9])[A-Z]{2}\\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Z0-9])", fold=True, valid=v.iban),
    Rule("US_SSN", "identity", 97, "(?<!\\d)\\d{3}[- ]\\d{2}[- ]\\d{4}(?!\\d)", valid=v.us_ssn),
    Rule("EN_DATE_OF_BIRTH", "quasi_identifier", 93, f"(?:date of birth|birth date|dob){FIELD}((?:19|20)\\d{{2}}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\\d|3[01])|(?:0?[1-9]|[12]\\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\\d{{2}})", 1, True),
    Rule("INTERNATIONAL_PHONE", "contact_location", 91, f"(?:phone|telephone|mobile|cell|contact number|tel){FIELD}(\\+?[0-9](?:[0-9 ()-]{{5,22}}[0-9]))", 1, True, v.international_phone),
    Rule("SWIFT_BIC_CONTEXT", "financial", 84, f"(?:swift|bic)(?: code)?{FIELD}([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)", 1, True),
    Rule("GENERIC_BANK_ACCOUNT_CONTEXT", "financial", 83, f"(?:bank account|account number|account no\\.?|beneficiary account|银行账号|账户号码){FIELD}([A-Z0-9](?:[ A-Z0-9-]{{4,32}})[A-Z0-9])", 1, True),
    Rule("EN_PERSON_NAME", "identity", 57, f"(?:full name|legal name|customer name|owner name|borrower name|applicant name|plaintiff name|defendant name|witness name|insured name){FIELD}([A-Z][A-Z'’.-]{{1,39}}(?:\\s+[A-Z][A-Z'’.-]{{1,39}}){{1,4}})", 1, True),
    Rule("EN_POSTAL_ADDRESS", "contact_location", 55, f"(?:residential address|mailing address|home address|property address|service address|address){FIELD}([^\\r\\n;；]{{6,160}})", 1, True),
    Rule("EN_ORGANIZATION_NAME", "organization", 53, "(?:(?:employer|company|organization|organisation|law firm)(?:[ ]+name)?[：:=][ \\t]{0,4}|(?:employer|company|organization|organisation|law firm)[ ]+name[ \\t]+)([^\\r\\n;；]{3,100})", 1, True),
    Rule("US_EIN_CONTEXT", "organization", 89, f"(?:ein|employer identification number|federal tax id){FIELD}(\\d{{2}}-\\d{{7}})", 1, True),
    Rule("US_ITIN_CONTEXT", "identity", 89, f"(?:itin|individual taxpayer identification number){FIELD}(9\\d{{2}}[- ](?:7\\d|8[0-8])[- ]\\d{{4}})", 1, True),
    Rule("US_ABA_ROUTING", "financial", 88, "(?<!\\d)\\d{9}(?!\\d)", valid=v.aba_routing),
    Rule("US_DRIVER_LICENSE_CONTEXT", "identity", 78, f"(?:driver'?s license|driver license|dl number|license no\\.?){FIELD}([A-Z0-9][A-Z0-9 -]{{3,24}})", 1, True),
    Rule("CANADA_SIN_CONTEXT", "identity", 90, f"(?:sin|social insurance number){FIELD}((?:\\d[ -]?){{8}}\\d)", 1, True, v.canadian_sin),
    Rule("CANADA_BANK_CONTEXT", "financial", 81, f"(?:transit|institution|canadian bank account|account number){FIELD}([0-9][0-9 -]{{4,24}}[0-9])", 1, True),
    Rule("UK_NINO", "identity", 92, "(?<![A-Z0-9])[A-Z]{2}[ -]?\\d{2}[ -]?\\d{2}[ -]?\\d{2}[ -]?[A-D]?(?![A-Z0-9])", fold=True, valid=v.uk_nino),
    Rule("UK_NHS_NUMBER_CONTEXT", "identity", 90, f"(?:nhs number|nhs no\\.?){FIELD}((?:\\d[ -]?){{9}}\\d)", 1, True, v.uk_nhs),
    Rule("UK_SORT_CODE_ACCOUNT", "financial", 88, f"(?:sort code){FIELD}(\\d{{2}}[- ]?\\d{{2}}[- ]?\\d{{2}}(?:[ ,;/]+(?:account|a/c)(?: number| no\\.?)?{FIELD}\\d{{8}})?)", 1, True),
    Rule("DE_TAX_ID_CONTEXT", "identity", 89, f"(?:steueridentifikationsnummer|steuer-id|tax identification number|idnr){FIELD}((?:\\d[ ]?){{10}}\\d)", 1, True, v.german_tax_id),
    Rule("FR_NIR_CONTEXT", "identity", 89, f"(?:nir|numéro de sécurité sociale|numero de securite sociale|social security number){FIELD}((?:\\d[ ]?){{14}}\\d)", 1, True, v.french_nir),
    Rule("ES_DNI_NIE", "identity", 90, "(?<![A-Z0-9])(?:\\d{8}|[XYZ]\\d{7})[- ]?[A-Z](?![A-Z0-9])", fold=True, valid=v.spanish_dni_nie),
    Rule("IT_CODICE_FISCALE", "identity", 90, "(?<![A-Z0-9])[A-Z]{6}\\d{2}[ABCDEHLMPRST]\\d{2}[A-Z]\\d{3}[A-Z](?![A-Z0-9])", fold=True, valid=v.italian_fiscal_code),
    Rule("NL_BSN_CONTEXT", "identity", 89, f"(?:bsn|burgerservicenummer|citizen service number){FIELD}(\\d{{9}})", 1, True, v.dutch_bsn),
    Rule("PL_PESEL_CONTEXT", "identity", 89, f"(?:pesel){FIELD}(\\d{{11}})", 1, True, v.polish_pesel),
    Rule("SE_PERSONNUMMER_CONTEXT", "identity", 88, f"(?:personnummer|personal identity number){FIELD}((?:\\d{{2}})?\\d{{6}}[-+ ]?\\d{{4}})", 1, True, v.swedish_person_number),
    Rule("NO_FODSELSNUMMER_CONTEXT", "identity", 88, f"(?:fødselsnummer|fodselsnummer|national identity number){FIELD}(\\d{{11}})", 1, True, v.norwegian_birth_number),
    Rule("DK_CPR_CONTEXT", "identity", 77, f"(?:cpr|personal identification number){FIELD}(\\d{{6}}[- ]?\\d{{4}})", 1, True),
    Rule("FI_HETU", "identity", 90, "(?<![A-Z0-9])\\d{6}[+\\-ABCDEFYXWVU]\\d{3}[0-9A-Z](?![A-Z0-9])", fold=True, valid=v.finnish_code),
    Rule("AU_TFN_CONTEXT", "identity", 89, f"(?:tfn|tax file number){FIELD}((?:\\d[ -]?){{7,8}}\\d)", 1, True, v.australian_tfn),
    Rule("AU_BSB_ACCOUNT", "financial", 87, f"(?:bsb){FIELD}(\\d{{3}}[- ]?\\d{{3}}(?:[ ,;/]+(?:account|a/c)(?: number| no\\.?)?{FIELD}\\d{{5,10}})?)", 1, True),
    Rule("NZ_IRD_CONTEXT", "identity", 89, f"(?:ird number|ird no\\.?){FIELD}((?:\\d[ -]?){{7,8}}\\d)", 1, True, v.new_zealand_ird),
    Rule("NZ_BANK_ACCOUNT_CONTEXT", "financial", 82, f"(?:new zealand bank account|nz bank account|account number){FIELD}(\\d{{2}}[- ]?\\d{{4}}[- ]?\\d{{7}}[- ]?\\d{{2,3}})", 1, True),
    Rule("JP_MY_NUMBER_CONTEXT", "identity", 91, f"(?:my number|個人番号|マイナンバー){FIELD}((?:\\d[ -]?){{11}}\\d)", 1, True, v.japan_my_number),
    Rule("KR_RESIDENT_NUMBER", "identity", 91, "(?<!\\d)\\d{6}[- ]?[1-8]\\d{6}(?!\\d)", valid=v.korean_resident),
    Rule("SG_NRIC_FIN", "identity", 92, "(?<![A-Z0-9])[STFGM]\\d{7}[A-Z](?![A-Z0-9])", fold=True, valid=v.singapore_nric),
    Rule("IN_AADHAAR", "identity", 92, "(?<!\\d)[2-9]\\d{3}[ -]?\\d{4}[ -]?\\d{4}(?!\\d)", valid=v.india_aadhaar),
    Rule("IN_PAN_CONTEXT", "identity", 88, f"(?:pan|permanent account number){FIELD}([A-Z]{{5}}\\d{{4}}[A-Z])", 1, True),
    Rule("IN_IFSC_ACCOUNT", "financial", 87, f"(?:ifsc){FIELD}([A-Z]{{4}}0[A-Z0-9]{{6}}(?:[ ,;/]+(?:account|a/c)(?: number| no\\.?)?{FIELD}[A-Z0-9]{{6,20}})?)", 1, True),
    Rule("HK_IDENTITY_CARD", "identity", 92, "(?<![A-Z0-9])[A-Z]{1,2}[ ]?\\d{6}[ ]?\\(?[0-9A]\\)?(?![A-Z0-9])", fold=True, valid=v.hong_kong_id),
    Rule("TW_NATIONAL_ID", "identity", 92, "(?<![A-Z0-9])[A-Z][12]\\d{8}(?![A-Z0-9])", fold=True, valid=v.taiwan_id),
    Rule("MO_BIR_CONTEXT", "identity", 82, f"(?:macau id|macao id|bir|澳門居民身份證|澳门居民身份证){FIELD}([157]\\d{{6}}\\(?\\d\\)?)", 1, True),
    Rule("VEHICLE_ENGINE_NUMBER_CONTEXT", "vehicle_property", 86, f"(?:engine number|engine no\\.?|motor number|发动机号|引擎号码){FIELD}([A-Z0-9][A-Z0-9./-]{{3,30}})", 1, True),
    Rule("VEHICLE_REGISTRATION_CONTEXT", "vehicle_property", 85, f"(?:vehicle registration|registration number|registration no\\.?|license plate|licence plate|plate number|车牌号|车辆登记号){FIELD}([A-Z0-9][A-Z0-9 -]{{2,20}})", 1, True),
    Rule("UK_LICENSE_PLATE_CONTEXT", "vehicle_property", 86, f"(?:registration|number plate|licence plate){FIELD}([A-Z]{{2}}\\d{{2}}[ ]?[A-Z]{{3}})", 1, True),
    Rule("VEHICLE_INSURANCE_POLICY_CONTEXT", "vehicle_property", 83, f"(?:vehicle insurance|auto insurance|motor insurance|policy number|policy no\\.?|车险保单号){FIELD}([A-Z0-9][A-Z0-9./-]{{4,40}})", 1, True),
    Rule("PROPERTY_PARCEL_CONTEXT", "property", 80, f"(?:parcel number|parcel id|assessor'?s parcel number|apn|cadastral number|cadastral parcel|lot number|地块编号|宗地号|地籍号){FIELD}([A-Z0-9][A-Z0-9./ -]{{3,50}})", 1, True),
    Rule("LAND_REGISTRY_TITLE_CONTEXT", "property", 80, f"(?:land registry title|title number|title no\\.?|deed number|deed no\\.?|property certificate|产权登记号|土地登记号|契据号){FIELD}([A-Z0-9][A-Z0-9./ -]{{3,50}})", 1, True),
    Rule("UK_UPRN_CONTEXT", "property", 84, f"(?:uprn|unique property reference number){FIELD}(\\d{{1,12}})", 1, True),
    Rule("MORTGAGE_ACCOUNT_CONTEXT", "property", 81, f"(?:mortgage account|mortgage loan number|loan account|property loan|按揭账号|抵押贷款编号){FIELD}([A-Z0-9][A-Z0-9./ -]{{4,40}})", 1, True),
    labelled("CN_RESIDENT_ID_15_CONTEXT", "identity", 95, "(?:旧版)?(?:居民)?身份证(?:号|号码)?", "[1-9]\\d{5}\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}", v.cn_resident_id_15),
    labelled("CN_HOUSEHOLD_REGISTER_CONTEXT", "identity", 88, "户口簿(?:号|编号)?|户籍(?:号|编号)|户口(?:号|编号)", IDENTIFIER),
    labelled("CN_BIRTH_CERTIFICATE_CONTEXT", "identity", 88, "出生医学证明(?:编号|号)?|出生证(?:编号|号)?", IDENTIFIER),
    labelled("CN_SOCIAL_SECURITY_CARD_CONTEXT", "identity", 90, "社会保障卡(?:号|号码)?|社保卡(?:号|号码)?", "[A-Z0-9][A-Z0-9 -]{7,29}[A-Z0-9]"),
    labelled("CN_MEDICAL_INSURANCE_NUMBER_CONTEXT", "health_medical", 89, "医疗保险(?:号|编号)|医保(?:号|编号)|参保人编号", IDENTIFIER),
    labelled("CN_DRIVER_LICENSE_CONTEXT", "identity", 90, "驾驶证(?:号|号码|档案编号)|机动车驾驶证(?:号|号码)?", IDENTIFIER),
    labelled("CN_VEHICLE_LICENSE_CONTEXT", "vehicle_property", 88, "行驶证(?:号|号码|编号)|机动车行驶证(?:号|号码|编号)?", IDENTIFIER),
    labelled("CN_PASSPORT_CONTEXT", "identity", 91, "中国护照(?:号|号码)?|护照(?:号|号码)", "[A-Z][A-Z0-9]{7,16}"),
    labelled("CN_MILITARY_ID_CONTEXT", "identity", 87, "军官证|士兵证|文职人员证|军人保障卡|军人证件", IDENTIFIER),
    labelled("CN_POLICE_ID_CONTEXT", "identity", 87, "人民警察证|警官证|警员证", IDENTIFIER),
    labelled("CN_LAWYER_LICENSE_CONTEXT", "legal_case", 91, "律师执业证(?:号|号码)?|律师证(?:号|号码)?", "\\d{17}"),
    labelled("CN_LEGAL_PROFESSIONAL_CERT_CONTEXT", "legal_case", 88, "法律职业资格证书(?:号|编号)?|法律职业资格证(?:号|编号)?", IDENTIFIER),
    labelled("CN_NOTARY_LICENSE_CONTEXT", "legal_case", 87, "公证员执业证(?:号|编号)?|公证员证(?:号|编号)?", IDENTIFIER),
    labelled("CN_JUDGE_ID_CONTEXT", "legal_case", 85, "法官(?:工作证|编号|工号)|审判员(?:编号|工号)", IDENTIFIER),
    labelled("CN_PROCURATOR_ID_CONTEXT", "legal_case", 85, "检察官(?:工作证|编号|工号)|检察员(?:编号|工号)", IDENTIFIER),
    labelled("CN_EMPLOYEE_NUMBER_CONTEXT", "employment", 80, "员工编号|员工号|人员编号|工号|职工编号|雇员编号", IDENTIFIER),
    labelled("CN_STUDENT_NUMBER_CONTEXT", "education", 84, "学号|学生编号|学生证号", "[A-Z0-9][A-Z0-9-]{4,29}"),
    labelled("CN_EXAM_ADMISSION_NUMBER_CONTEXT", "education", 84, "准考证号|考试报名号|考生号", "[A-Z0-9][A-Z0-9-]{5,39}"),
    labelled("CN_PATIENT_ID_CONTEXT", "health_medical", 86, "患者编号|患者ID|病人编号|病人ID|就诊卡号", IDENTIFIER),
    labelled("CN_MEDICAL_RECORD_CONTEXT", "health_medical", 90, "病历号|病案号|门诊号|住院号|住院流水号", IDENTIFIER),
    labelled("CN_PRESCRIPTION_NUMBER_CONTEXT", "health_medical", 84, "处方号|处方编号|电子处方号", IDENTIFIER),
    labelled("CN_LAB_SAMPLE_CONTEXT", "health_medical", 86, "检验单号|检查单号|样本编号|标本编号|病理号|切片号", IDENTIFIER),
    labelled("CN_HEALTH_RECORD_CONTEXT", "health_medical", 87, "健康档案号|健康档案编号|居民健康档案编号", IDENTIFIER),
    labelled("CN_BIOMETRIC_SAMPLE_CONTEXT", "identity", 88, "指纹编号|声纹编号|虹膜编号|DNA样本编号|DNA编号", IDENTIFIER),
    labelled("CN_BANK_ACCOUNT_CONTEXT", "financial", 92, "银行账号|银行账户|结算账户|收款账号|付款账号|基本账户|一般账户", ACCOUNT),
    labelled("CN_CNAPS_CODE_CONTEXT", "financial", 90, "联行号|支付系统行号|CNAPS(?: code)?|银行行号", "\\d{12}"),
    labelled("CN_BANK_BRANCH_CONTEXT", "financial", 78, "开户行|开户银行|收款行|付款行|开户支行", "[^，。；;\\r\\n]{3,80}"),
    labelled("CN_BANK_CARD_CVV_CONTEXT", "financial", 94, "CVV2?|CVC2?|安全码", "\\d{3,4}"),
    labelled("CN_BANK_CARD_EXPIRY_CONTEXT", "financial", 82, "银行卡有效期|卡片有效期|有效期至|expiry", "(?:0[1-9]|1[0-2])[/\\-](?:\\d{2}|20\\d{2})"),
    labelled("CN_ALIPAY_ACCOUNT_CONTEXT", "financial", 89, "支付宝账号|支付宝账户|支付宝绑定手机|Alipay account", "[^，。；;\\r\\n]{5,80}"),
    labelled("CN_WECHAT_PAY_ACCOUNT_CONTEXT", "financial", 88, "微信支付账号|微信支付账户|微信支付商户账号", "[^，。；;\\r\\n]{5,80}"),
    labelled("CN_UNIONPAY_MERCHANT_CONTEXT", "financial", 86, "银联商户号|商户编号|商户号|merchant id", "[A-Z0-9][A-Z0-9-]{5,31}"),
    labelled("CN_PAYMENT_TRANSACTION_CONTEXT", "financial", 87, "支付交易号|支付流水号|交易订单号|支付订单号", IDENTIFIER),
    labelled("CN_BANK_TRANSACTION_CONTEXT", "financial", 87, "银行流水号|交易流水号|回单编号|银行回单号", IDENTIFIER),
    labelled("CN_LOAN_ACCOUNT_CONTEXT", "financial", 88, "贷款账号|贷款账户|借据号|借款编号|贷款合同编号", IDENTIFIER),
    labelled("CN_CREDIT_REPORT_CONTEXT", "financial", 88, "征信报告编号|信用报告编号|个人信用报告编号|查询授权编号", IDENTIFIER),
    labelled("CN_SECURITIES_ACCOUNT_CONTEXT", "financial", 88, "证券账户|证券账号|股东账号|资金账号", "[A-Z0-9][A-Z0-9-]{5,29}"),
    labelled("CN_FUND_ACCOUNT_CONTEXT", "financial", 86, "基金账户|基金账号|基金交易账号|TA账号", "[A-Z0-9][A-Z0-9-]{5,29}"),
    labelled("CN_FUTURES_ACCOUNT_CONTEXT", "financial", 86, "期货账户|期货账号|期货资金账号", "[A-Z0-9][A-Z0-9-]{5,29}"),
    labelled("CN_INSURANCE_POLICY_CONTEXT", "financial", 88, "保险单号|保单号|投保单号|保险合同编号", IDENTIFIER),
    labelled("CN_INSURANCE_CLAIM_CONTEXT", "financial", 87, "理赔编号|理赔号|保险报案号|赔案号", IDENTIFIER),
    labelled("CN_TAXPAYER_ID_CONTEXT", "financial", 93, "纳税人识别号|税务登记号|税号", "[0-9A-HJ-NPQRTUWXY]{15,20}"),
    labelled("CN_ORGANIZATION_CODE_CONTEXT", "organization", 90, "组织机构代码|机构代码", "[A-Z0-9]{8}-?[A-Z0-9]"),
    labelled("CN_TAX_INVOICE_CODE_CONTEXT", "financial", 87, "发票代码", "\\d{10,12}"),
    labelled("CN_TAX_INVOICE_NUMBER_CONTEXT", "financial", 87, "发票号码|发票号", "\\d{8,20}"),
    labelled("CN_SALARY_FIELD_CONTEXT", "employment", 75, "工资|薪酬|薪资|月薪|年薪|奖金|实发金额|应发金额", MONEY),
    labelled("CN_PROVIDENT_FUND_ACCOUNT_CONTEXT", "financial", 88, "公积金账号|住房公积金账户|公积金个人账号", ACCOUNT),
    labelled("CN_SOCIAL_INSURANCE_ACCOUNT_CONTEXT", "financial", 87, "社保个人编号|社会保险个人编号|养老保险个人编号", IDENTIFIER),
    labelled("CN_PENSION_ACCOUNT_CONTEXT", "financial", 86, "养老金账户|企业年金账户|职业年金账户", ACCOUNT),
    labelled("CN_DIGITAL_WALLET_CONTEXT", "financial", 85, "数字人民币钱包|数字货币钱包|虚拟资产钱包|wallet address", "[A-Z0-9][A-Z0-9:_-]{15,127}"),
    Rule("IPV6_ADDRESS", "network_security", 93, "(?<![0-9A-F:])(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}(?![0-9A-F:])", fold=True, valid=v.ipv6),
    Rule("IPV4_CIDR", "network_security", 91, "(?<![0-9.])(?:\\d{1,3}\\.){3}\\d{1,3}/(?:[0-9]|[12]\\d|3[0-2])(?![0-9])", fold=True, valid=v.ipv4_cidr),
    Rule("IPV6_CIDR", "network_security", 91, "(?<![0-9A-F:])(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}/(?:\\d|[1-9]\\d|1[01]\\d|12[0-8])(?![0-9])", fold=True, valid=v.ipv6_cidr),
    Rule("MAC_ADDRESS_DOTTED", "network_security", 92, "(?<![0-9A-F])(?:[0-9A-F]{4}\\.){2}[0-9A-F]{4}(?![0-9A-F])", fold=True),
    labelled("DOMAIN_NAME_CONTEXT", "network_security", 84, "域名|domain(?: name)?|站点域名", "(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+[A-Z]{2,63}"),
    labelled("HOSTNAME_CONTEXT", "network_security", 83, "主机名|服务器名|hostname|server name", "[A-Z0-9][A-Z0-9._-]{1,252}"),
    Rule("URL_QUERY_SECRET", "network_security", 99, "(?:[?&](?:token|access_token|api_key|apikey|secret|password|passwd|session|sid)=)([^&#\\s]{4,512})", 1, True),
    labelled("EMAIL_MESSAGE_ID_CONTEXT", "network_security", 82, "Message-ID|邮件消息ID|邮件唯一标识", "<?[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+>?"),
    labelled("IMEI_CONTEXT", "network_security", 98, "IMEI(?:1|2)?|设备IMEI", "\\d{15}", v.imei),
    labelled("IMSI_CONTEXT", "network_security", 89, "IMSI|国际移动用户识别码", "\\d{15}"),
    labelled("ICCID_CONTEXT", "network_security", 98, "ICCID|SIM卡号|集成电路卡识别码", "\\d{19,20}", v.iccid),
    labelled("DEVICE_SERIAL_CONTEXT", "network_security", 84, "设备序列号|设备SN|序列号|serial number|device id", IDENTIFIER),
    labelled("WIFI_SSID_CONTEXT", "network_security", 80, "Wi-?Fi名称|无线网络名称|SSID", "[^，。；;\\r\\n]{1,32}"),
    labelled("VPN_ACCOUNT_CONTEXT", "network_security", 88, "VPN账号|VPN账户|VPN用户名|vpn user", "[A-Z0-9._@-]{3,128}"),
    labelled("DATABASE_CONNECTION_CONTEXT", "network_security", 96, "数据库连接|连接字符串|JDBC URL|database url|connection string", "[^，；;\\r\\n]{8,300}"),
    labelled("API_KEY_CONTEXT", "network_security", 99, "API[ _-]?Key|接口密钥|应用密钥|AppSecret|ClientSecret", "[A-Z0-9_./+\\-=]{8,512}"),
    labelled("ACCESS_TOKEN_CONTEXT", "network_security", 99, "Access[ _-]?Token|访问令牌|认证令牌|Bearer", "[A-Z0-9_./+\\-=]{8,2048}"),
    Rule("JWT_TOKEN", "network_security", 99, "(?<![A-Z0-9_-])eyJ[A-Z0-9_-]{5,}\\.eyJ[A-Z0-9_-]{5,}\\.[A-Z0-9_-]{8,}(?![A-Z0-9_-])", fold=True),
    labelled("PASSWORD_CONTEXT", "network_security", 100, "密码|口令|登录密码|交易密码|password|passwd|pwd", "[^\\s，。；;]{4,256}"),
    Rule("WINDOWS_USER_PATH", "network_security", 82, "(?<![A-Z0-9_])[A-Z]:\\\\Users\\\\[^\\\\\\r\\n]{1,80}(?:\\\\[^\\r\\n:*?\"<>|]{1,120})*", fold=True),
    Rule("UNC_PATH", "network_security", 84, "\\\\\\\\[A-Z0-9._-]+\\\\[^\\r\\n:*?\"<>|]{1,120}(?:\\\\[^\\r\\n:*?\"<>|]{1,120})*", fold=True),
    labelled("GPS_COORDINATES_CONTEXT", "geography_location", 86, "经纬度|坐标|GPS|longitude|latitude|纬度|经度", "[-+]?\\d{1,3}(?:\\.\\d{3,8})?[,， ]+[-+]?\\d{1,3}(?:\\.\\d{3,8})?", v.coordinates),
    labelled("CN_ADMIN_DIVISION_CODE_CONTEXT", "geography_location", 91, "行政区划代码|区划代码|统计用区划代码|城乡划分代码", "\\d{2}(?:\\d{2}(?:\\d{2}(?:\\d{3})?)?)?"),
    Rule("CN_ROAD_ADDRESS", "geography_location", 88, "[\\p{IsHan}]{2,24}(?:大道|公路|胡同|路|街|巷|弄)\\d{1,6}号(?:[A-Z0-9\\p{IsHan}-]{0,30})", fold=True),
    labelled("CN_BUILDING_ROOM_CONTEXT", "geography_location", 82, "楼栋房间|房间号|门牌号|房号|室号", "[A-Z0-9\\p{IsHan}-]{1,30}(?:栋|幢|座)?[A-Z0-9\\p{IsHan}-]{0,20}(?:单元)?[A-Z0-9\\p{IsHan}-]{0,20}(?:室|号)"),
    Rule("GLOBAL_CONTINENT", "geography_location", 64, "(?:亚洲|欧洲|非洲|北美洲|南美洲|大洋洲|南极洲|欧亚大陆|(?<![A-Z])(?:Asia|Europe|Africa|North America|South America|Oceania|Antarctica)(?![A-Z]))", fold=True),
    labelled("CN_BIRTHPLACE_CONTEXT", "geography_location", 84, "出生地|出生地点", HAN_VALUE),
    labelled("CN_NATIVE_PLACE_CONTEXT", "geography_location", 84, "籍贯|祖籍", HAN_VALUE),
    labelled("CN_REGISTERED_RESIDENCE_CONTEXT", "geography_location", 95, "户籍地址|户口所在地|户籍所在地", HAN_VALUE),
    labelled("CN_CURRENT_RESIDENCE_CONTEXT", "geography_location", 95, "现住址|现居住地|现居地址|经常居住地", HAN_VALUE),
    labelled("CN_DELIVERY_ADDRESS_CONTEXT", "geography_location", 95, "送达地址|邮寄地址|收件地址|通信地址", HAN_VALUE),
    labelled("CN_PROPERTY_ADDRESS_CONTEXT", "property", 95, "房屋坐落|不动产坐落|物业地址|涉案房产地址", HAN_VALUE),
    labelled("CN_WORKPLACE_ADDRESS_CONTEXT", "employment", 94, "工作单位地址|单位地址|办公地址", HAN_VALUE),
    labelled("CN_SCHOOL_ADDRESS_CONTEXT", "education", 94, "学校地址|就读学校地址|院校地址", HAN_VALUE),
    labelled("CN_GEO_GRID_CODE_CONTEXT", "geography_location", 80, "网格编码|地理网格码|社区网格编号", IDENTIFIER),
    labelled("CN_COURT_NAME_CONTEXT", "legal_case", 83, "受理法院|审理法院|执行法院|管辖法院|人民法院", "[\\p{IsHan}]{2,40}人民法院"),
    labelled("CN_PROCURATORATE_NAME_CONTEXT", "legal_case", 83, "检察机关|承办检察院|人民检察院", "[\\p{IsHan}]{2,40}人民检察院"),
    labelled("CN_POLICE_STATION_CONTEXT", "legal_case", 82, "公安机关|办案单位|派出所", "[\\p{IsHan}]{2,50}(?:公安局|公安分局|派出所)"),
    labelled("CN_DETENTION_CENTER_CONTEXT", "legal_case", 82, "羁押场所|看守所|拘留所", "[\\p{IsHan}]{2,50}(?:看守所|拘留所)"),
    labelled("CN_PRISON_CONTEXT", "legal_case", 82, "服刑监狱|关押监狱|监狱", "[\\p{IsHan}]{2,50}监狱"),
    labelled("CN_CASE_FILE_NUMBER_CONTEXT", "legal_case", 90, "案卷号|卷宗号|卷宗编号|档案号|案卷编号", IDENTIFIER),
    labelled("CN_POLICE_CASE_NUMBER_CONTEXT", "legal_case", 90, "公安案号|接报案编号|受案登记号|立案编号|案件编号", IDENTIFIER),
    labelled("CN_PROCURATOR_CASE_NUMBER_CONTEXT", "legal_case", 90, "检察案号|审查起诉案号|检察案件编号", IDENTIFIER),
    labelled("CN_EXECUTION_CASE_NUMBER_CONTEXT", "legal_case", 90, "执行案号|执行案件编号|执行依据文号", IDENTIFIER),
    labelled("CN_BANKRUPTCY_CASE_NUMBER_CONTEXT", "legal_case", 87, "破产案号|破产案件编号|管理人案件编号", IDENTIFIER),
    labelled("CN_ARBITRATION_CASE_NUMBER_CONTEXT", "legal_case", 88, "仲裁案号|仲裁案件编号|仲裁受理号", IDENTIFIER),
    labelled("CN_MEDIATION_CASE_NUMBER_CONTEXT", "legal_case", 86, "调解案号|调解案件编号|人民调解编号", IDENTIFIER),
    labelled("CN_LEGAL_AID_CASE_NUMBER_CONTEXT", "legal_case", 86, "法律援助案号|法律援助案件编号|法援编号", IDENTIFIER),
    labelled("CN_EVIDENCE_NUMBER_CONTEXT", "legal_case", 87, "证据编号|物证编号|检材编号|扣押物编号|涉案物品编号", IDENTIFIER),
    labelled("CN_DOSSIER_BARCODE_CONTEXT", "legal_case", 88, "卷宗条码|案卷条码|电子卷宗编号|卷宗二维码编号", IDENTIFIER),
    labelled("CN_JUDICIAL_APPRAISAL_NUMBER_CONTEXT", "legal_case", 88, "鉴定书编号|司法鉴定编号|鉴定意见书编号|检验报告编号", IDENTIFIER),
    labelled("CN_ENFORCEMENT_TARGET_CONTEXT", "legal_case", 78, "执行标的|债务金额|欠款金额|赔偿金额", MONEY),
    labelled("CN_PARTY_NAME_CONTEXT", "legal_case", 92, "当事人|原告|被告|申请人|被申请人|上诉人|被上诉人|申诉人|债权人|债务人", PERSON),
    labelled("CN_AGENT_NAME_CONTEXT", "legal_case", 90, "代理人|委托代理人|诉讼代理人|辩护人|法律顾问", PERSON),
    labelled("CN_JUDGE_CLERK_NAME_CONTEXT", "legal_case", 90, "审判长|审判员|人民陪审员|法官助理|书记员|执行员", PERSON),
    labelled("CN_WITNESS_NAME_CONTEXT", "legal_case", 90, "证人|鉴定人|勘验人|翻译人员", PERSON),
    labelled("CN_VICTIM_NAME_CONTEXT", "legal_case", 92, "被害人|受害人|死者|伤者", PERSON),
    labelled("CN_CONTACT_PERSON_CONTEXT", "contact_location", 87, "联系人|收件人|紧急联系人|经办人|负责人", PERSON),
    labelled("CN_PROPERTY_UNIT_NUMBER_CONTEXT", "property", 92, "不动产单元号|不动产单元代码", "\\d{12}[A-Z]{2}\\d{5}[A-Z]\\d{8}"),
    labelled("CN_HOUSE_CERT_NUMBER_CONTEXT", "property", 89, "房屋所有权证号|房权证号|房产证号", IDENTIFIER),
    labelled("CN_LAND_CERT_NUMBER_CONTEXT", "property", 89, "土地使用权证号|国有土地使用证号|土地证号", IDENTIFIER),
    labelled("CN_HOMESTEAD_CERT_CONTEXT", "property", 88, "宅基地证号|农村宅基地批准书编号|农村产权证号", IDENTIFIER),
    labelled("CN_CADASTRAL_NUMBER_CONTEXT", "property", 88, "地籍号|地籍编号|宗地代码", IDENTIFIER),
    labelled("CN_PARCEL_NUMBER_CONTEXT", "property", 88, "宗地号|宗地编号|地块编号|土地编号", IDENTIFIER),
    labelled("CN_BUILDING_NUMBER_CONTEXT", "property", 80, "楼栋号|楼号|幢号|建筑物编号", "[A-Z0-9\\p{IsHan}-]{1,30}"),
    labelled("CN_ROOM_NUMBER_CONTEXT", "property", 80, "房号|室号|房屋编号|单元房号", "[A-Z0-9\\p{IsHan}-]{1,30}"),
    labelled("CN_LEASE_CONTRACT_CONTEXT", "property", 86, "租赁合同编号|房屋租赁备案号|租赁备案编号", IDENTIFIER),
    labelled("CN_MORTGAGE_REGISTRATION_CONTEXT", "property", 88, "抵押登记号|抵押证明号|不动产登记证明号", IDENTIFIER),
    labelled("CN_VEHICLE_REGISTRATION_CERT_CONTEXT", "vehicle_property", 88, "机动车登记证书编号|车辆登记证编号|登记证书编号", IDENTIFIER),
    labelled("CN_TRAFFIC_ACCIDENT_CONTEXT", "vehicle_property", 87, "事故编号|交通事故编号|违法编号|处罚决定书编号", IDENTIFIER),
    labelled("CN_ETC_ACCOUNT_CONTEXT", "vehicle_property", 85, "ETC账号|ETC账户|电子标签编号|OBU编号", IDENTIFIER),
    labelled("CN_PARKING_SPACE_CONTEXT", "property", 78, "车位号|停车位编号|车库编号", "[A-Z0-9\\p{IsHan}-]{1,30}"),
    labelled("CN_UTILITY_ACCOUNT_CONTEXT", "property", 82, "水费户号|电费户号|燃气户号|供暖户号|宽带账号|有线电视户号", IDENTIFIER),
    labelled("CN_METER_NUMBER_CONTEXT", "property", 80, "水表号|电表号|燃气表号|计量表编号", IDENTIFIER),
)


@dataclass(frozen=True)
class RuleSet:
    """Rules and lists. Every change makes a new set with the next version."""

    rules: tuple[Rule, ...] = BUILT_IN
    disabled: frozenset[str] = frozenset()
    blacklist: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    version: int = 0

    def _next(self, **changes: object) -> RuleSet:
        return replace(self, version=self.version + 1, **changes)

    @property
    def enabled(self) -> list[Rule]:
        return [r for r in self.rules if r.rule_id not in self.disabled]

    def only(self, *rule_ids: str) -> RuleSet:
        return self._next(disabled=frozenset(r.rule_id for r in self.rules) - frozenset(rule_ids))

    def disable(self, *rule_ids: str) -> RuleSet:
        return self._next(disabled=self.disabled | set(rule_ids))

    def categories(self, *names: str) -> RuleSet:
        """Only rules of these categories; none named: all. The black list stays."""
        if not names:
            return self
        chosen = {n.lower() for n in names}
        return self._next(disabled=self.disabled | {r.rule_id for r in self.rules if r.category.lower() not in chosen})

    def with_lists(self, black: list[str] | None = None, white: list[str] | None = None) -> RuleSet:
        return self._next(blacklist=self.blacklist + clean_list(black or []), whitelist=clean_list([*self.whitelist, *(white or [])]))

    @property
    def custom(self) -> list[Rule]:
        return [r for r in self.rules if r.rule_id.startswith("CUSTOM_")]

    def with_custom(self, name: str, category: str, priority: int, pattern: str) -> RuleSet:
        rule = custom_rule(name, category, priority, pattern)
        if any(r.rule_id == rule.rule_id for r in self.rules):
            raise ValueError(f"there is a rule {rule.rule_id} already")
        if len(self.custom) >= MOST_CUSTOM:
            raise ValueError(f"more than {MOST_CUSTOM} custom rules")
        return self._next(rules=(*self.rules, rule))

    def with_changed(self, name: str, category: str, priority: int, pattern: str) -> RuleSet:
        rule = custom_rule(name, category, priority, pattern)
        if all(r.rule_id != rule.rule_id for r in self.custom):
            raise ValueError(f"there is no custom rule {rule.rule_id}")
        return self._next(rules=tuple(rule if r.rule_id == rule.rule_id else r for r in self.rules))

    def without_custom(self, rule_id: str) -> RuleSet:
        if all(r.rule_id != rule_id for r in self.custom):
            raise ValueError(f"there is no custom rule {rule_id}")
        return self._next(rules=tuple(r for r in self.rules if r.rule_id != rule_id), disabled=self.disabled - {rule_id})

    def exported(self) -> str:
        """The custom rules as JSON."""
        return json.dumps([{"id": r.rule_id, "category": r.category, "priority": r.priority, "regex": r.pattern} for r in self.custom], ensure_ascii=False)

    def imported(self, text: str, replace_all: bool = False) -> RuleSet:
        """With the custom rules of a JSON text: beside the present ones, where ids may not clash, or in their place."""
        known = {r.rule_id: r for r in self.rules if not (replace_all and r.rule_id.startswith("CUSTOM_"))}
        given = [x for x in json.loads(text) if x]
        if not given:
            raise ValueError("no custom rules")
        own: dict[str, Rule] = {}
        for x in given:
            rule = custom_rule(x["id"], x["category"], int(x["priority"]), x["regex"])
            if rule.rule_id in known or rule.rule_id in own and not replace_all:
                raise ValueError(f"there is a rule {rule.rule_id} already")
            own[rule.rule_id] = rule
        rules = (*known.values(), *own.values())
        ids = {r.rule_id for r in rules}
        if sum(i.startswith("CUSTOM_") for i in ids) > MOST_CUSTOM:
            raise ValueError(f"more than {MOST_CUSTOM} custom rules")
        return self._next(rules=rules, disabled=frozenset(d for d in self.disabled if not d.startswith("CUSTOM_") or d in ids))

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.category, r.priority, r.group, r.rule_id not in self.disabled, i) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_id string, category string, priority int, capture_group int, enabled boolean, ord int")


def clean_list(values: list[str], most: int = 6000) -> tuple[str, ...]:
    """Terms without control characters, trimmed, each once whatever its case, the first spelling kept."""
    out: dict[str, str] = {}
    for value in values:
        term = re.sub(r"[\x00-\x1f\x7f]", " ", value).strip()
        if len(term) > 200:
            raise ValueError("a term has over 200 characters")
        if term:
            out.setdefault(term.lower(), term)
    if len(out) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(out.values())


#: How many custom rules and versions of a rule set are kept.
MOST_CUSTOM, MOST_VERSIONS = 100, 20


@dataclass(frozen=True)
class History:
    """The last versions of a rule set, the newest first."""

    sets: tuple[RuleSet, ...] = ()

    def saved(self, rules: RuleSet) -> History:
        return History((rules, *(r for r in self.sets if r.version != rules.version))[:MOST_VERSIONS])

    def rolled_back(self, version: int) -> History:
        """With the set of an earlier version as a new version on top."""
        old = next((r for r in self.sets if r.version == version), None)
        if old is None:
            raise ValueError(f"there is no version {version}")
        return self.saved(replace(old, version=max(r.version for r in self.sets) + 1))


def custom_rule(name: str, category: str, priority: int, pattern: str) -> Rule:
    check_custom(pattern)
    return Rule(custom_id(name), category, priority, pattern, 0, True)


def custom_id(name: str) -> str:
    own = re.sub(r"[^A-Z0-9_]", "_", name.strip().upper())
    return (own if own.startswith("CUSTOM_") else f"CUSTOM_{own}")[:67]


def check_custom(pattern: str) -> None:
    """Raises a ValueError where a user's pattern isn't Java's syntax, is empty or long, looks around or back, may match nothing, or may be matched in so many ways that a text takes more than linear time."""
    if not 1 <= len(pattern) <= 500:
        raise ValueError("a pattern has 1 to 500 characters")
    tree = patterns.parsed(pattern)
    if any(isinstance(x, patterns.Look | patterns.Back) for x in patterns.nodes(tree)):
        raise ValueError("no look-around and no back-references")
    if patterns.least(tree) == 0:
        raise ValueError("the pattern matches the empty text")
    if kind := patterns.ambiguity(tree):
        raise ValueError(f"the pattern's repeats may share a text in many ways: {kind} time")
