"""Tag families: words that assign a channel or remark text to a behaviour.

Operators take families as arguments. These are the defaults for the bank data the feature blocks and
alert rules were designed on; any mapping with the same names can replace them.
"""

# Channel text families.
CHANNEL_TAGS = {
    "topup": ["TOPUP"],
    "payment": ["PEMBAYARAN"],
    "va": ["VIRTUAL ACCOUNT"],
    "cash_out": ["TRANSFER", "TARIKAN", "VIRTUAL ACCOUNT", "TOPUP", "TOP UP"],
    "edc": ["EDC", "PEMBELIAN"],
    "edc_only": ["EDC"],
    "clearing": ["CLG", "COLL IB", "REALTIME COLL"],
    "atm_cash": ["TARIKAN TUNAI", "TUNAI VIA ATM"],
    "withdrawal": ["TARIKAN TUNAI"],
    "atm": ["ATM"],
    "self_transfer": ["KE PRODUK DN"],
    "own_product": ["PRODUK DN"],
    "salary": ["PENERIMAAN ASNM"],
    "merchant_in": ["IB-SME"],
    "settlement": ["SETTLEMENT", "ASNM", "CRID", "LBLL"],
    "merchant_settle": ["IB-SME", "SETTLEMENT", "ASNM"],
    "merchant_dominant": ["IB-SME", "SETTLEMENT"],
    "merchant_pay": ["AHAH", "EDC LAIN"],
    "cash_deposit": ["SETORAN TUNAI"],
    "batch_in": ["AKAO", "SAME CURRENCY"],
    "bash": ["BASH"],
    "bash_in": ["BASH", "NON-CUST"],
    "bash_wide": ["BASH", "NON-CUST", "CLG", "BANK LAIN"],
    "spending": ["EDC", "ATM", "PEMBELIAN", "TARIKAN"],
}

# Remark and summary words used by the alert rules.
REMARK_TAGS = {
    "transfer_in": ["跨行网银贷记", "转账", "数字人民币兑回", "往来款", "委托实时贷记", "普通贷记来帐"],
    "transfer_short": ["跨行网银贷记", "转账", "数字人民币兑回", "往来款", "委托实时贷记"],
    "standard_credit": ["普通贷记来帐"],
    "entrusted": ["委托实时贷记"],
    "interbank": ["跨行网银贷记"],
    "wallet": ["支付宝"],
    "withdraw": ["提现"],
    "goods": ["商品"],
    "shopping": ["商品", "商户"],
    "loan": ["借款"],
    "fund": ["基金"],
    "live_stream": ["抖音"],
    "repay": ["贷款提前归还", "还款"],
    "refund": ["代付代付退款"],
    "reversal": ["冲销"],
    "cash": ["取款", "现金"],
    "cash_taken": ["现金", "取现"],
    "cash_word": ["现金"],
    "to_credit_card": ["转贷记卡"],
}
REMARK_NOISE = ["手续费", "短信费", "利息"]
SUMMARY_NOISE = ["手续费", "卡年费", "利息"]
HOME_REGION = "广东"
CARD_PREFIX, CARD_LENGTHS = "62", (16, 19)
