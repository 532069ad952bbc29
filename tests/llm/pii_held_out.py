"""Sentences for testing the tagger: names, numbers and wordings that neither training nor any table holds, spans marked ``[[kind|text]]``."""

SENTENCES = [
    "The keynote was given by [[name|Satya Nadella]] in a packed hall.",
    "[[name|Siobhan O'Callaghan]] has the spare key.",
    "We still wait for a reply of [[name|Nguyễn Văn An]].",
    "Das Paket hat [[name|Juan Pérez]] angenommen.",
    "An opera by [[name|Giuseppe Verdi]] was on the radio.",
    "[[name|Bartholomew Cholmondeley-Warner]] never pays on time.",
    "Did you hear what [[name|Tomasz Grzybowski]] said?",
    "Our guest tonight: [[name|Prof. Annalena Hirschvogel]]",
    "Nobody knows the way better than [[name|Rasmus Kjærgaard]].",
    "The flat is let to [[name|Mrs. Penhaligon]] until June.",
    "Signed on behalf of [[name|T. Abernathy]].",
    "photo taken by [[name|gwendolyn fairbrother]]",
    "Hochachtungsvoll\n[[name|Ekkehard Zwingenberger]]",
    "Le dossier est chez [[name|Mme Delacroix]].",
    "Estimada [[name|Doña Remedios]], le escribo por la factura.",
    "[[name|VANDERBILT, Cornelia]] is next on the list.",
    "A word with [[name|Mr. Oyelaran]] would help.",
    "[[name|Leocadia Montalbán]] firmó el contrato.",
    "来週は[[name|三枝 直樹]]さんが出張です。",
    "[[name|桐生かおり]]様からお電話です。",
    "In memory of [[name|Hortense P. Lovelace]].",
    "Is [[name|Dr. Farnsworth]] in today?",
    "Scrivo per conto di [[name|Ludovica Sanseverino]].",
    "The winner, [[name|Zoltán Berényi]], could not come.",
    "[[name|Anne-Marie Lecouvreur]] chairs the panel.",
    "Tell us more at [[email|dolores.quintana@vinecraft.org]] or not at all.",
    "The list owner is [[email|tkowalczyk77@uni-lodz.pl]].",
    "billing goes to [[email|accounts@fairweather-shipping.co.uk]]",
    "You can also use [[email|p_hargreaves [at] tidewater [dot] net]].",
    "Neue Mailadresse: [[email|kerstin.obermaier@gmx.de]]",
    "He signs as [[email|GREGOR.SAMSA@CASTLE.CZ]] these days.",
    "ping [[email|ops+night@relay.io]] if the job dies",
    "[[email|huertas(at)correo.es]] ya no funciona.",
    "返信先は[[email|mori.k@sample-web.jp]]でお願いします。",
    "reachable as [[email|bjorn at fjordline dot no]] only",
    "Adresse : [[email|jp.lemoine@laposte.fr]]",
    "We got a bounce from <[[email|mailer-9@bulk.example.com]]>.",
    "If the gate is shut, ring [[phone|212-736-5000]].",
    "The plumber's number is [[phone|(503) 228-4651]].",
    "Leave a message on [[phone|+44 161 496 0182]].",
    "Erreichbar sind wir unter [[phone|0711 / 904218]] bis 18 Uhr.",
    "Mein Festnetz: [[phone|089 4423 7710]]",
    "Mon portable est le [[phone|06 48 91 27 35]].",
    "Apunta mi móvil: [[phone|655 204 918]].",
    "Per urgenze chiamare il [[phone|+39 348 771 2206]].",
    "連絡先 [[phone|080-6612-9047]] まで。",
    "You may fax the form to [[phone|415.552.7780]].",
    "My cell is [[phone|9175531284]], call any time.",
    "Rufnummer: [[phone|+49 151 22841973]]",
    "Reception: [[phone|+33 1 44 58 92 10]]",
    "Her social security number was [[id_number|412-68-9035]].",
    "passport number [[id_number|K4471902]], issued in Leeds",
    "NI number: [[id_number|JH 41 88 02 B]]",
    "Mein Personalausweis hat die Nummer [[id_number|T22000129]].",
    "DNI [[id_number|48271936K]], expedido en Burgos",
    "Der Antragsteller nannte seine Steuer-ID [[id_number|47 036 892 815]].",
    "SSN [[id_number|338 41 7720]] on file",
    "driver's license number [[id_number|F255-9215-0094]]",
    "tax ID [[id_number|84-2917365]] for the return",
    "マイナンバーは[[id_number|4821 7730 9162]]です。",
    "NIE: [[id_number|Y4417820T]]",
    "codice fiscale [[id_number|RSSMRA85T10A562S]]",
    "Sozialversicherungsnummer [[id_number|65 170839 J 008]] liegt vor.",
    "They live at [[address|48 Pemberley Crescent, Harrogate HG1 5QX]].",
    "Forward the mail to [[address|1906 Cottonwood Drive, Boise, ID 83702]].",
    "Our shop is at [[address|77 Fishergate]], two doors down.",
    "Send the keys to [[address|PO Box 4417, Flagstaff]].",
    "Neuer Wohnsitz: [[address|Kastanienallee 28, 10435 Berlin]]",
    "Wir treffen uns in der [[address|Goethestraße 9, 60313 Frankfurt]].",
    "El taller está en [[address|Calle Mayor 17, 3º D, Zaragoza]].",
    "Mon bureau : [[address|14 rue des Martyrs, 75009 Paris]]",
    "届け先は[[address|神奈川県鎌倉市雪ノ下3-7-12]]です。",
    "Return it to [[address|Flat 12, 230 Bermondsey Street, London SE1 3TQ]].",
    "She moved to [[address|5512 Kingfisher Ln Apt 9, Tampa, FL 33615]] last year.",
    "Abito in [[address|Via Garibaldi 31, 16124 Genova]].",
    "Lieferanschrift: [[address|Am Mühlgraben 6, 04109 Leipzig]]",
]
#: Texts that name nobody: every span found in them is wrong.
NOBODY = [
    "The train to Edinburgh leaves at 09:42 from platform 7, and the next one at 10:15.",
    "Version 4.12.1 fixes issue #2231; see the release notes of 2023-11-08.",
    "Transfer the fee to IBAN DE89 3704 0044 0532 0130 00 by Friday.",
    "Golden Gate Bridge and Central Park were both closed on Sunday.",
    "Order 7741-22093 contains 3 lamps, 2 carpets and a kettle.",
    "The server 192.168.14.77 refused the connection on port 5432.",
    "Machine Learning and Data Mining is the title of chapter 12.",
    "Der Zug nach Freiburg fällt heute aus, der nächste fährt um 16:05 Uhr.",
    "La reunión empieza a las 10:30 y termina antes de comer.",
    "The dough rests for 40 minutes; then fold it twice and wait again.",
    "Select the rows where total > 1500 and export them as CSV.",
    "会議は午後3時から始まり、資料は12ページあります。",
    "He read the poem twice, slowly, and put the book back on the shelf.",
    "Use `pip install pandas==2.2.1` and restart the kernel.",
    "Great Britain, New Zealand and South Africa sent three teams each.",
    "Room 214 is on the second floor, next to the Blue Lounge.",
    "The invoice total of 1,284.50 EUR is due on 15.03.2024.",
    "Il museo apre alle nove e chiude alle diciotto, tranne il lunedì.",
    "ISBN 978-0-14-044913-6 is out of print.",
    "The commit 9f2c1ab7 broke the build of branch release-1.9.",
]
