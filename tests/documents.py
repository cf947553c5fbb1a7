"""Synthetic documents for the tests."""

NS = "urn:test:documents"


def header(number="N1", extra="", date="2021-03-04", total="100.50", status="Approved", vendor="Acme"):
    return (
        f"<DocumentHeader><DocumentNumber>{number}</DocumentNumber><DocumentDate>{date}</DocumentDate><DocumentType>Invoice</DocumentType>"
        f"<CurrencyCode>USD</CurrencyCode><Total>{total}</Total><LineCount>2</LineCount><PeriodDate>2021-03-31</PeriodDate>{extra}"
        f"<Action><ActionType>Review</ActionType><Status>{status}</Status><TransactionDateTime>{date}T10:00:00</TransactionDateTime></Action>"
        "<Action><Status>Later</Status></Action>"
        '<Party PartyRole="Client"><Entity><EntityCode EntityCodeType="T">C1</EntityCode><EntityName>Buyer</EntityName></Entity></Party>'
        f'<Party PartyRole="Vendor"><Entity><EntityCode>V1</EntityCode><EntityName>{vendor}</EntityName></Entity>'
        "<Location><LocationCode>L1</LocationCode><Address><City>Town</City></Address></Location></Party>"
        '<Party PartyRole="Vendor"><Entity><EntityName>Second</EntityName></Entity></Party></DocumentHeader>'
    )


def line(n, extra="", allocation="<Allocation><CostCenter>own</CostCenter></Allocation>"):
    return f"<LineEntry><LineNumber>{n}</LineNumber><Quantity>4</Quantity><Units>EA</Units><UnitPrice>2.5</UnitPrice><Total>10.0</Total>{extra}{allocation}</LineEntry>"


def document(variant="DetailedInvoice", invoice_id="1", head=None, lines="", shared="", ns=NS):
    attribute = f' invoice_id="{invoice_id}"' if invoice_id is not None else ""
    return (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- c --><StandardBillingDocument xmlns="{ns}"{attribute}><{variant}>{header() if head is None else head}'
        f"<DocumentLines>{shared}{lines}</DocumentLines></{variant}></StandardBillingDocument>"
    )
