"""23 transactions and the feature vector each must get."""

# transaction_id, timestamp, sender_account, receiver_account, amount, payment_currency, received_currency, sender_country, receiver_country, payment_type
TRANSACTIONS = [
    ("FX-0001", "2022-10-01T09:00:00+00:00", "ACC-A", "ACC-B", 1000.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0002", "2022-10-01T09:01:00+00:00", "ACC-A", "ACC-C", 250.5, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0003", "2022-10-01T09:01:00+00:00", "ACC-A", "ACC-B", 99.99, "TRY", "TRY", "TR", "TR", "cheque"),  # noqa: E501
    ("FX-0004", "2022-10-01T09:01:00+00:00", "ACC-D", "ACC-B", 5000.0, "TRY", None, None, None, None),  # noqa: E501
    ("FX-0005", "2022-10-01T11:00:00+00:00", "ACC-A", "ACC-B", 1200.0, "EUR", "TRY", "TR", "DE", "cross_border"),  # noqa: E501
    ("FX-0006", "2022-10-02T09:00:00+00:00", "ACC-A", "ACC-D", 300.0, "TRY", "TRY", "TR", "TR", "Debit card"),  # noqa: E501
    ("FX-0007", "2022-10-02T09:01:00+00:00", "ACC-A", "ACC-B", 410.25, "TRY", "TRY", "TR", "TR", "cash_withdrawal"),  # noqa: E501
    ("FX-0007", "2022-10-02T09:01:00+00:00", "ACC-A", "ACC-B", 410.25, "TRY", "TRY", "TR", "TR", "cash_withdrawal"),  # noqa: E501
    ("FX-0008", "2022-10-04T09:00:00+00:00", "ACC-E", "ACC-F", 77.0, "usd", "eur", "ZZ", "de", "crypto"),  # noqa: E501
    ("FX-0009", "2022-10-08T09:00:00+00:00", "ACC-A", "ACC-C", 600.0, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0010", "2022-10-08T09:00:01+00:00", "ACC-A", "ACC-C", 650.0, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0011", "2022-10-16T09:00:00+00:00", "ACC-A", "ACC-B", 20000.0, "TRY", None, "TR", "TR", "Credit Card"),  # noqa: E501
    ("FX-0020", "2022-10-21T09:00:00+00:00", "ACC-G1", "ACC-H", 9500.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0021", "2022-10-21T09:10:00+00:00", "ACC-G2", "ACC-H", 9501.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0022", "2022-10-21T09:20:00+00:00", "ACC-G3", "ACC-H", 9502.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0023", "2022-10-21T09:30:00+00:00", "ACC-G4", "ACC-H", 9503.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0024", "2022-10-21T09:40:00+00:00", "ACC-G5", "ACC-H", 9504.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0025", "2022-10-21T09:50:00+00:00", "ACC-G1", "ACC-H", 9400.0, "TRY", "TRY", "TR", "TR", "cash_deposit"),  # noqa: E501
    ("FX-0026", "2022-10-21T09:50:00+00:00", "ACC-H", "ACC-X", 47000.0, "TRY", "AED", "TR", "AE", "cross_border"),  # noqa: E501
    ("FX-0027", "2022-10-22T09:00:00+00:00", "ACC-K", "ACC-K", 15.0, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0028", "2022-10-22T12:00:00+03:00", "ACC-B", "ACC-A", 12345678.9, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0029", "2022-10-22T12:01:00+00:00", "ACC-K", "ACC-K", 15.0, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
    ("FX-0030", "2022-10-22T12:01:00+00:00", "ACC-B", "ACC-A", 1.0, "TRY", "TRY", "TR", "TR", "ach"),  # noqa: E501
]

# One vector per row, in feature order.
EXPECTED = [
    [6.908754825592041, 9, 5, 2, 0, 0, 1, 1, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [5.527442932128906, 9, 5, 1, 0, 0, 1, 1, 1, 1000.0, 1, 0, 0, 0, 60.0],  # noqa: E501
    [4.615021705627441, 9, 5, 4, 0, 0, 1, 1, 2, 1250.5, 2, 1, 1, 1, 0.0],  # noqa: E501
    [8.517393112182617, 9, 5, 0, 0, 0, 1, 1, 0, 0.0, 0, 2, 1, 0, -1.0],  # noqa: E501
    [7.090909957885742, 11, 5, 6, 1, 1, 1, 6, 3, 1350.489990234375, 2, 3, 2, 2, 7140.0],  # noqa: E501
    [5.707110404968262, 9, 6, 7, 0, 0, 1, 1, 4, 2550.489990234375, 2, 0, 0, 0, 79200.0],  # noqa: E501
    [6.019201278686523, 9, 6, 3, 0, 0, 1, 1, 4, 1850.489990234375, 3, 3, 2, 3, 60.0],  # noqa: E501
    [6.019201278686523, 9, 6, 3, 0, 0, 1, 1, 4, 1850.489990234375, 3, 3, 2, 3, 60.0],  # noqa: E501
    [4.356709003448486, 9, 1, 0, 1, 1, 0, 6, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [6.398594856262207, 9, 5, 1, 0, 0, 1, 1, 0, 0.0, 3, 0, 1, 1, 518340.0],  # noqa: E501
    [6.478509426116943, 9, 5, 1, 0, 0, 1, 1, 1, 600.0, 3, 1, 1, 2, 1.0],  # noqa: E501
    [9.90353775024414, 9, 6, 5, 0, 0, 1, 1, 0, 0.0, 0, 0, 0, 0, 691199.0],  # noqa: E501
    [9.159152030944824, 9, 4, 2, 0, 0, 1, 1, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [9.159257888793945, 9, 4, 2, 0, 0, 1, 1, 0, 0.0, 0, 1, 1, 0, -1.0],  # noqa: E501
    [9.15936279296875, 9, 4, 2, 0, 0, 1, 1, 0, 0.0, 0, 2, 2, 0, -1.0],  # noqa: E501
    [9.159467697143555, 9, 4, 2, 0, 0, 1, 1, 0, 0.0, 0, 3, 3, 0, -1.0],  # noqa: E501
    [9.159573554992676, 9, 4, 2, 0, 0, 1, 1, 0, 0.0, 0, 4, 4, 0, -1.0],  # noqa: E501
    [9.148571014404297, 9, 4, 2, 0, 0, 1, 1, 1, 9500.0, 1, 5, 5, 1, 3000.0],  # noqa: E501
    [10.75792407989502, 9, 4, 6, 1, 1, 1, 2, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [2.7725887298583984, 9, 5, 1, 0, 0, 1, 1, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [16.32881736755371, 9, 5, 1, 0, 0, 1, 1, 0, 0.0, 0, 0, 0, 0, -1.0],  # noqa: E501
    [2.7725887298583984, 12, 5, 1, 0, 0, 1, 1, 1, 15.0, 1, 1, 1, 1, 10860.0],  # noqa: E501
    [0.6931471824645996, 12, 5, 1, 0, 0, 1, 1, 1, 12345679.0, 1, 1, 1, 1, 10860.0],  # noqa: E501
]
