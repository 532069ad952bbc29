"""Training of the tagger for personal information: ``python -m chatlake.llm.pii_training [STEPS] [LOCALE_FOLDER ...]``.

Labelled spans are made by rule: forms of names, mail addresses, phone numbers, identity numbers
and street addresses of many countries are put into sentences that mention them, or anywhere into
other text. Around them stand sentences of public software (see ``spam_training``) and its manual
pages, sentences built from everyday words, and sentences whose numbers and capitals mean something
else. No table of threads takes part in training.
The weights and the alphabet are written to ``pii_model.npz`` beside this file.

Each step adds up the gradients of several processes, so a large batch takes the time of a small one.
``--resume`` goes on from the model that is there, ``--average STATE ...`` writes the mean of several of its states; the
model here is the mean of the last three of one training of 23,400 steps, to which sentences were added on the way.
"""

from __future__ import annotations

import gzip
import multiprocessing
import os
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np

from chatlake.llm.pii_model import CLASSES, TAGS, Adam, Tagger, folded
from chatlake.llm.spam_training import LANGUAGES, messages, pod_paragraphs

MODEL = Path(__file__).with_name("pii_model.npz")
#: Characters in a training window; also of a decoding window.
WINDOW = 112
#: Sentences of each language at most.
SENTENCES = 4_000
#: Manual pages, in English and translated.
MANUALS = "/usr/share/man"

# Common given names and family names of several countries: (given, family).
PEOPLE = {
    "en": (
        "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Siobhan Niamh Owen Rhys Fiona Callum Gareth Imogen Rupert Beatrice Harriet Will Grace Hope Faith Mason Hunter Chase".split(),
        "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Nelson Baker Campbell Mitchell Carter Roberts Turner Phillips Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Morgan Cooper Reed Bailey Bell Kelly Howard Ward Cox Richardson Wood Watson Brooks Bennett Gray Hughes Price Myers Long Foster Sanders Ross Powell Sullivan Russell May Page Fletcher Pemberton Ashworth Whitaker Hathaway".split(),
    ),
    "ie": ("Aoife Ciarán Declan Maeve Padraig Sinead Eoin Brigid".split(), "O'Brien O'Connor O'Neill O'Reilly McCarthy MacDonald McGregor MacLeod Fitzgerald Gallagher Doherty Byrne D'Arcy".split()),
    "de": ("Lukas Leon Finn Elias Felix Paul Ben Jürgen Wolfgang Dieter Uwe Heike Sabine Ursula Monika Renate Gisela Brigitte Anke Björn Käthe Günther Lieselotte Friedrich Heinrich Johanna Katharina Sebastian Matthias".split(), "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Schmitt Werner Krause Meier Lehmann Köhler Herrmann Kaiser Fuchs Scholz Möller Weiß Jung Hahn Vogel Schubert Roth Baumgartner Gruber".split()),
    "fr": ("Jean Pierre Michel André Philippe Nathalie Isabelle Sylvie Catherine Françoise Camille Chloé Léa Hugo Louis Jules Margaux Thérèse Benoît Élodie Aurélie Rémi Gaëlle Jean-Luc Anne-Sophie".split(), "Martin Bernard Dubois Durand Moreau Laurent Simon Michel Lefebvre Leroy Roux Bertrand Morel Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau Vincent Faure Mercier Blanc Guérin Boyer Garnier Chevalier Legrand Lemaître Beaumont".split()),
    "es": ("José Juan Antonio Manuel Francisco Javier Carmen Dolores Pilar Teresa Rosario Mercedes Alejandro Diego Sergio Álvaro Raúl Rubén Íñigo Ximena Guadalupe Lucía Sofía Martín Nicolás Inés Begoña Joaquín".split(), "García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Muñoz Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Serrano Blanco Molina Castro Ortega Rubio Núñez Medina Iglesias Cortés Castillo Zubizarreta".split()),
    "it": ("Giuseppe Giovanni Antonio Mario Luigi Francesca Giulia Chiara Alessandro Lorenzo Davide Simone Federica Valentina Caterina Rosa Angela Salvatore Vincenzo Niccolò".split(), "Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Greco Bruno Gallo Conti De Luca Costa Giordano Mancini Rizzo Lombardi Moretti Verdi D'Angelo Dell'Acqua Pellegrini".split(" ")),
    "pt": ("João Tiago Rui Nuno Catarina Beatriz Mariana Leonor Inácio Gonçalo Fernanda Letícia Thiago Rafael Juliana Adriana Luís Vítor".split(), "Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Sousa Fernandes Gonçalves Gomes Lopes Marques Alves Almeida Ribeiro Pinto Carvalho Teixeira Moreira Correia Mendes Nunes".split()),
    "nl": ("Daan Sem Bram Lars Thijs Femke Sanne Lotte Anouk Maaike Joost Wouter Pieter Jeroen Marijke Geert".split(), "de Jong;Jansen;de Vries;van den Berg;Bakker;van Dijk;Visser;Smit;Meijer;de Boer;Mulder;de Groot;Bos;Vos;Peters;Hendriks;van Leeuwen;Dekker;van der Meer;Brouwer;van 't Hoff".split(";")),
    "nordic": ("Erik Lars Astrid Freja Sigrid Bjørn Søren Åsa Maja Nils Gunnar Solveig Mikkel Henrik Aino Eero Väinö Kalle Guðrún Jón".split(), "Andersson Johansson Karlsson Nilsson Eriksson Larsson Olsson Persson Hansen Johansen Olsen Larsen Andersen Pedersen Nielsen Jensen Sørensen Lindström Bergström Åkesson Korhonen Virtanen Mäkinen Jónsdóttir Sigurðsson".split()),
    "east": ("Agnieszka Piotr Krzysztof Małgorzata Wojciech Zofia Jakub Jan Tomáš Jiří Lenka Zdeněk István László Katalin Zsófia Andrei Ioana Mihai Elena Dragan Milica Goran Jovana Dmitri Svetlana Oleksandr Yulia".split(), "Nowak Kowalski Wiśniewski Wójcik Kamiński Lewandowska Zieliński Szymański Novák Svoboda Dvořák Černý Nagy Kovács Tóth Szabó Horváth Popescu Ionescu Petrović Nikolić Horvat Ivanov Petrova Shevchenko Kovalenko Bondarenko".split()),
    "south": ("Satya Sundar Rahul Ananya Rohan Aditi Vikram Lakshmi Deepak Kavita Sanjay Meera Imran Ayesha Bilal Zainab Tariq Nadia Mohammed Ahmed Hassan Khadija Youssef Layla Mehmet Ayşe Mustafa Elif Emre Zeynep Reza Shirin".split(), "Nadella Pichai Sharma Patel Singh Kumar Gupta Reddy Iyer Banerjee Chatterjee Khan Malik Hussain Rahman Chowdhury Al-Masri El-Sayed bin Rashid Haddad Mansour Yılmaz Kaya Demir Şahin Çelik Hosseini Tehrani".split(" ")),
    "asia": ("Wei Jing Xiaoming Lihua Haoran Minh Thị Văn Hương Anh Nguyen Jiho Minjun Seoyeon Hyun-woo Ji-eun Takeshi Haruto Sakura Ayumi Kenta Naoki Budi Siti Putri Somchai Arthit".split(), "Zhang Wang Liu Chen Huang Zhao Zhou Trần Nguyễn Phạm Hoàng Lê Kim Park Choi Jung Tanaka Suzuki Watanabe Yamamoto Nakamura Kobayashi Wijaya Santoso Suharto Chaiyasit Tan Lim Goh".split()),
    "africa": ("Chinedu Ngozi Oluwaseun Adaeze Kwame Abena Thabo Nomvula Wanjiru Otieno Tendai Fatoumata Mamadou Aminata".split(), "Okafor Adeyemi Okonkwo Mensah Owusu Dlamini Nkosi Mbeki Kamau Odhiambo Moyo Diallo Traoré Ndiaye Tesfaye Bekele".split()),
}
_RUSSIAN = ("Иван Алексей Дмитрий Сергей Андрей Анна Мария Елена Ольга Наталья Татьяна Николай Екатерина Павел Юлия Виктор".split(), "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Лебедев Семёнов Егоров Павлов Козлов Степанов".split())
_KANJI_FAMILY = "山川田村木林森石井原野本中上下大小高橋島崎藤松竹梅谷沢池岡坂浜津宮寺古新北南東西水火土金白黒青赤雪雨風空海花草葉星月日光岩砂泉清長永安平和早秋冬春夏夜朝"
_KANJI_GIVEN = "美子郎太一介香織恵健誠学真由紀優翔大輝涼陽菜結衣葵莉彩奈花音悠斗蓮樹海空智哲也明博文雄久和弘幸正義"
_KANA_GIVEN = "さくら あかり ひなた はると そうた ゆい めい こはる りん つむぎ すみれ かえで たける しおり まこと のぞみ アキラ ケンタ ミサキ ユウタ レイナ サトシ マリコ タクヤ エリカ ジュン ナツキ ショウ カナコ ヒロシ".split()
_CHINESE = ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂兰文华玉建国红梅")
_KOREAN = ("김이박최정강조윤장임한오서신권황안송류홍", "민준서연지우현수영진하은도윤예슬기태성호재경미")
# Parts of invented names: beginnings, vowels, middles and ends of syllables.
_ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pl pr qu r s sch sh sk sl sm sn sp st str t th tr v w wh y z zh ".split(" ")
_VOWELS = "a e i o u a e i o u ae ai au ea ee ei eu ie io oa oo ou y ä ö ü é á í ó".split()
_CODAS = "b ck d g k l ll m n nn nd ng nt p r rd rk rn rs s ss st t tt x z ".split(" ") + [""] * 22
_ENDINGS = "son sen man mann er berg feld stein ton ley well field worth wood ford ham by ski sky ska ova ov ev ic escu ini elli etti ez es eiro ier ard eau oux ak uk enko yan ian opoulos dottir a o i e el en in on holm brand quist vale moor land gren dahl strom".split()

_WORD_TITLES = "Mr Mr. Ms Ms. Mrs Mrs. Miss Dr Dr. Prof. Professor Sir Dame Herr Frau Hr. Fr. Dr.-Ing. Señor Señora Sr. Sra. Don Doña Monsieur Madame M. Mme Mlle Signor Signora Sig. Dott. Sr Sra Senhor Dona Dhr. Mevr. Pan Pani Captain Capt. Judge Rev. Sergeant".split()

# Parts of streets and towns.
_NATURE = "oak elm ash birch cedar pine maple rose lily stone rock mill river brook lake hill dale wind snow rain sun moon star iron copper silver gold red green white black blue long high low old new north south east west king queen bishop abbot fox hare stag raven crow swan deer wolf bear otter badger clover fern heather bramble thistle harvest meadow market chapel tower garden orchard spring summer winter candle hammer anvil shepherd weaver potter cooper".split()
_PLACE = "field bridge gate hollow bank wick ley ton ford ham worth stead bury dale side well brook wood combe mouth port haven moor mere cliff stoke thorpe by burn cross den end hurst land shaw stow".split()
_STREET_KINDS = "Street Avenue Road Lane Terrace Drive Close Court Place Square Way Crescent Boulevard Highway Parkway Grove Gardens Row Mews Blvd St St. Rd Rd. Ave Ave. Dr Dr. Ln Ct Pl Hwy Cres".split()
_GERMAN_TREES = "Linden Eichen Buchen Ahorn Kastanien Tannen Rosen Garten Schul Haupt Bahnhof Kirch Wiesen Berg Mühlen Schiller Goethe Mozart Park Wald Feld Dorf Brunnen Nord Süd Ring Markt Hafen Ziegel Sonnen Birken Ulmen Erlen Muster Bach Stein".split()
_GERMAN_TOWNS = "Neu Alt Ober Unter Nieder Hohen Groß Klein Schön Wald Stein Moor Quell See".split(), "burg dorf heim hausen feld bach berg stadt furt bronn stetten ried au kirchen quell moor tal".split()
_CITIES = "London Paris Berlin Madrid Roma Lisboa Boston Chicago Denver Seattle Portland Austin Leeds Bristol Glasgow Dublin Köln Hamburg München Leipzig Wien Zürich Sevilla Valencia Bilbao Lyon Marseille Nantes Milano Torino Napoli Porto Amsterdam Utrecht Gent Oslo Malmö Kraków Praha Budapest Istanbul Toronto Sydney Mumbai Delhi Manila".split()
_SPANISH_STREETS = "las Flores;los Naranjos;la Fuente;la Luna;los Almendros;las Acacias;la Estación;los Pinos;San Juan;Santa Clara;Cervantes;Goya;la Constitución;las Palmeras;el Molino;la Iglesia;los Molinos;las Eras;Alcalá;Serrano;Colón;la Paz;los Rosales;la Encina;las Viñas".split(";")
_FRENCH_STREETS = "de la Paix;des Lilas;du Moulin;Victor Hugo;de la Gare;des Écoles;Pasteur;de l'Église;du Château;Jean Jaurès;des Acacias;de Rivoli;Voltaire;du Marché".split(";")
_ITALIAN_STREETS = "Roma;Garibaldi;Mazzini;Dante Alighieri;della Libertà;dei Mille;Cavour;Verdi;del Corso;San Marco;delle Rose;Leopardi".split(";")
_JAPANESE_TOWN = "山川田村木林森石井原野本中上下大小高島松竹梅谷沢池岡坂浜津宮寺古新北南東西水白黒青赤雪風空海花草葉星月光岩砂泉清長永桜緑霧雲苔若"
_DOMAIN_WORDS = "sun moon star river stone cloud green bright north lake hill mail post web net data soft tech star book shop home office school city town bank news blog media art food auto garden travel sport club group studio works desk lab box point line link hub yard shelf field lane stack notes moor".split()
_TLDS = "com org net de es fr it nl jp co.uk io edu gov info eu ch at pt br in au ca example test invalid local dev app me biz se pl ru".split()
_LOCAL_WORDS = "info sales support hello contact team news office admin billing jobs press help shop label work".split()

# Sentences that mention personal information, by kind; East Asian and Russian ones apart.
MENTIONS = {
    "name": (
        ["会議には{}が出席します。", "{}さんから返事がありました。", "こちらは{}です。", "送信者 {}", "差出人：{}", "差出人 {}", "宛名：{}", "{}様", "{}さんはいますか。", "申込者は{}です", "{}様、ご確認ください。", "昨日{}さんに会いました。", "氏名：{}", "責任者は{}氏です。", "{}と言います。", "{}先生の講義を受けた。", "連絡は{}さんまで。", "{}より", "{}が担当します。", "友人の{}と話した。", "我叫{}。", "请联系{}。", "姓名：{}", "{}昨天来过。", "제 이름은 {}입니다.", "담당자: {}", "{} 씨에게 전해 주세요.", "Меня зовут {}.", "Передайте это {}, пожалуйста.", "{} позвонит завтра.", "С уважением,\n{}", "Автор: {}"],
        ["I met {} yesterday.", "{} will join us at noon.", "This was reviewed by {}.", "Thanks to {} for the help.", "Hi, this is {}.", "Please forward it to {}.", "Send {} a copy.", "Has {} answered yet?", "Author: {}", "Attendees: {}", "Name: {}", "Customer: {}", "signed, {}", "Yours sincerely,\n{}", "Cheers,\n{}", "Thanks,\n{}", "Best,\n{}", "Sincerely, {}", "to: {}", "From: {}", "{} wrote that nothing works.", "{} is my neighbour.", "My manager is {}.", "The speaker was {}, who left early.", "A letter for {} came today.", "I work with {} every day.", "Ask {} about the keys.", "We hired {} last week.", "According to {}, it rained.", "They call me {}.", "Kept by {}.", "the account of {}", "say hello to {} for us", "minutes by {}", "You may reach {} in the afternoon.", "{} forgot the password.", "{} just left a message.", "Tell {} that we are late.", "It belongs to {}", "Would you invite {} as well?", "Contact person: {}", "Interview with {}", "{} and I agreed.", "Greetings from {}!", "Cc {}", "Approved: {}", "This is a note from {}",
         "Mein Name ist {}.", "Ich bin {} und habe eine Frage.", "{} kommt morgen.", "Bitte geben Sie das {}.", "Mit freundlichen Grüßen\n{}", "Liebe Grüße, {}", "Gestern traf ich {}.", "Ansprechpartner: {}", "Der Bericht stammt von {}.", "Frag doch {} danach.", "{} hat geschrieben.", "gez. {}", "Danke an {}!", "Absender: {}",
         "Mi nombre es {}.", "Soy {} y necesito ayuda.", "{} llegó tarde.", "Habla con {} mañana.", "Un abrazo,\n{}", "Saludos cordiales, {}", "Nombre: {}", "Ayer vi a {}.", "Gracias a {} por todo.", "El informe es de {}.", "Remitente: {}", "{} dejó un mensaje.", "Avisa a {}.", "Redactado por {}",
         "Je m'appelle {}.", "Bonjour, ici {}.", "{} arrive demain.", "Cordialement,\n{}", "Merci à {} pour son aide.", "Demandez à {}.", "Nom : {}", "Mi chiamo {}.", "Ho parlato con {}.", "Cordiali saluti,\n{}", "Chiedi a {}.", "O meu nome é {}.", "Falei com {} ontem.", "Atenciosamente,\n{}", "Mijn naam is {}.", "Met vriendelijke groet,\n{}", "Vraag het aan {}.", "Jag heter {}.", "Nazywam się {}.", "Z poważaniem\n{}"],
    ),
    "email": (
        ["メールアドレスは{}です。", "お問い合わせは {} まで。", "{}へお送りください。", "宛先：{}", "邮箱：{}", "请发到 {}。", "이메일: {}", "Почта: {}", "Пишите на {}."],
        ["My e-mail address is {}.", "Email: {}", "email {} for details", "You'll find me at {}.", "Send it to {} please.", "Questions? {}", "I wrote from {} last time.", "Use {} instead.", "Forward everything to {}.", "The login is {}.", "cc {}", "It bounced from {}.", "{} is my new address.", "Unsubscribe {} now.", "Drop a line to {}", "Support: {}", "Meine E-Mail ist {}.", "Senden Sie es an {}.", "Kontakt: {}", "Erreichbar unter {}.", "Mi e-mail: {}", "Mándalo a {}.", "Contacto: {}", "El usuario {} no existe.", "Mon adresse : {}", "Envoyez-le à {}.", "Scrivi a {}.", "Escreva para {}.", "Mail naar {}.", "Skriv till {}."],
    ),
    "phone": (
        ["電話番号は{}です。", "{}までお電話ください。", "携帯：{}", "TEL {}", "手机：{}", "请拨打 {}。", "전화 {}", "Тел. {}", "Звоните по номеру {}."],
        ["My phone number is {}.", "Phone: {}", "Please ring {} tonight.", "Mobile {}", "cell: {}", "Give me a call at {}.", "SMS to {}", "Dial {} for help.", "Our office line is {}.", "Fax: {}", "The new number is {}.", "WhatsApp {}", "Tel: {}", "tel {}", "Reach me under {} after five.", "Call {} or wait.", "He left {} as his number.", "contact {} at once", "Hotline {}", "Text me at {}.", "text {}", "phone {}", "Meine Nummer ist {}.", "Tel.: {}", "Telefon: {}", "Mobil {}", "Rufen Sie {} an.", "Handynummer {}", "Mi número es el {}.", "Tel. {}", "Móvil: {}", "Llama al {}.", "Teléfono {}", "Mon numéro : {}", "Appelez le {}.", "Tél. {}", "Chiama il {}.", "Cellulare {}", "Ligue para {}.", "Bel {} voor hulp.", "Ring {}."],
    ),
    "id_number": (
        ["{}を提出しました。", "申請書に{}と記入。", "控えは{}です。", "{}で登録済みです。", "{}已登记。", "{} 로 등록했습니다.", "В анкете {}."],
        ["I have {} here.", "My {} was stolen.", "{} is required.", "The form asks for {}.", "Please check {}.", "I gave them {} last week.", "Applicant: {}", "It says {} on the letter.", "record: {}", "{} expires soon.", "We need {} by Friday.", "{}, please confirm.", "her {} is wrong", "He typed {} again.", "The copy shows {}.", "They took down {}.", "Verified against {}.", "Meine {} lautet so.", "Bitte prüfen: {}", "Im Antrag steht {}.", "{} ist abgelaufen.", "Ich nannte {}.", "Mi {} ha caducado.", "Piden {} en la solicitud.", "Adjunto {}.", "{} figura en la carta.", "Anoté {}.", "Mon {} est là.", "Indiquez {}.", "Ecco {}.", "Segue {}.", "Mijn {} staat erop."],
    ),
    "address": (
        ["住所は{}です。", "{}へ送ってください。", "届け先：{}", "{}に引っ越しました。", "〒{}", "本社 {}", "地址：{}", "寄到{}。", "주소: {}", "Адрес: {}"],
        ["My address is {}.", "Address: {}", "I live at {}.", "Deliver to {} before noon.", "Mail it to {}.", "The office is at {}.", "They moved from {}.", "Ship to: {}", "Billing address: {}", "We are at {} now.", "Come to {} tomorrow.", "The letter went to {}.", "Pick it up at {}.", "Home: {}", "The house at {} is empty.", "Her new place is {}", "Return to {}", "Meet me in front of {}.", "Meine Adresse ist {}.", "Adresse: {}", "Anschrift: {}", "Ich wohne {}.", "Schicken Sie es an {}.", "Das Paket ging nach {}.", "Mi dirección es {}.", "Domicilio: {}", "Vivo en {}.", "Envíelo a {}.", "La oficina está en {}.", "Nos mudamos a {}.", "J'habite {}.", "Adresse : {}", "Livrez au {}.", "Abito in {}.", "Indirizzo: {}", "Moro na {}.", "Morada: {}", "Ik woon {}.", "Adres: {}"],
    ),
}
_LABELS = [
    ("SSN ", ["###-##-####", "### ## ####", "#########"]), ("SSN: ", ["###-##-####", "#########"]), ("ssn ", ["###-##-####"]), ("social security number ", ["###-##-####", "### ## ####", "#########"]), ("social security no. ", ["###-##-####"]), ("my social: ", ["###-##-####"]), ("social is ", ["###-##-####", "#########"]), *[("", ["###-##-####"])] * 5, ("", ["### ## ####"]),
    ("NI number ", ["AA ## ## ## A", "AA######A"]), ("National Insurance number ", ["AA ## ## ## A", "AA######A"]), ("NINO ", ["AA######A"]), ("", ["AA ## ## ## A"]),
    ("driver's licence ", ["A###-####-####", "A#######", "A####-#####-#####", "########"]), ("driving licence ", ["AAAAA######AA#AA", "AAAAA ###### AA#AA"]), ("driver license number ", ["A#######", "A###-####-####"]), ("licence number ", ["AAAAA######A##AA"]),
    ("passport ", ["A#######", "#########", "AA#######"]), ("passport no. ", ["A#######", "#########", "A########"]), ("passport number ", ["A########", "AA######", "#########"]), ("passport number: ", ["AA#######", "A#######"]), ("Passport: ", ["A########"]),
    ("tax ID ", ["##-#######", "###########"]), ("tax number ", ["###/###/#####", "##-#######"]), ("insurance number ", ["A#########", "AA-######-##"]), ("policy number ", ["AA-######-##", "AAA#######"]), ("insurance policy ", ["AA-######-##"]), ("national ID ", ["##########", "A########"]), ("ID card ", ["A########", "AA######"]), ("SIN ", ["### ### ###"]), ("TFN ", ["### ### ###"]), ("PAN ", ["AAAAA####A"]), ("Aadhaar ", ["#### #### ####"]), ("residence permit ", ["AA#######", "A########"]),
    ("DNI ", ["########A", "########-A"]), ("DNI: ", ["########-A", "########A"]), ("NIE ", ["X#######A", "Y#######A", "X-#######-A"]), ("NIF ", ["########A"]), ("pasaporte ", ["AAA######", "AA######"]), ("número de la seguridad social ", ["## ######## ##", "##/########/##"]), ("seguridad social ", ["## ######## ##"]), ("cédula ", ["#.###.###.###", "########"]), ("carné de conducir ", ["########-A"]),
    ("Steuer-ID ", ["## ### ### ###", "###########"]), ("Steuernummer ", ["###/###/#####", "## ### #####"]), ("Ausweisnummer ", ["A##A#####", "A#####A##", "AA##A####"]), ("Personalausweis ", ["A##A#####", "A##AA####"]), ("Reisepass ", ["A########", "AA#######"]), ("Reisepass Nr. ", ["A########"]), ("Sozialversicherungsnummer ", ["## ###### A ###", "##A#######"]), ("Versichertennummer ", ["A#########"]), ("Führerschein ", ["A###AA##A##"]), ("Krankenkasse ", ["A#########"]),
    ("numéro de sécurité sociale ", ["# ## ## ## ### ### ##"]), ("passeport ", ["##AA#####"]), ("carte d'identité ", ["############"]), ("codice fiscale ", ["AAAAAA##A##A###A"]), ("passaporto ", ["AA#######"]), ("CPF ", ["###.###.###-##"]), ("NIF: ", ["#########"]), ("BSN ", ["#########", "####.##.###"]), ("paspoort ", ["AA#######"]), ("PESEL ", ["###########"]), ("personnummer ", ["######-####"]),
    ("マイナンバー ", ["#### #### ####", "####-####-####", "############"]), ("個人番号 ", ["#### #### ####", "############"]), ("旅券番号 ", ["AA#######"]), ("パスポート番号 ", ["AA#######"]), ("免許証番号 ", ["############"]), ("保険証番号 ", ["########"]), ("身份证号 ", ["##################"]), ("护照 ", ["A########"]), ("주민등록번호 ", ["######-#######"]), ("паспорт ", ["#### ######"]), ("СНИЛС ", ["###-###-### ##"]),
]
_PHONES = [
    "+1 ### ### ####", "+1-###-###-####", "+1 (###) ###-####", "+1.###.###.####", "###-###-####", "(###) ###-####", "(###)###-####", "###.###.####", "### ### ####", "##########", "##########", "1-800-###-####", "###-###-#### ext. ##", "###-###-#### ext. ###", "###-###-#### x###", "tel:+1-###-###-####",
    "+44 20 #### ####", "+44 7### ######", "+44 7### ### ###", "+44 (0)20 #### ####", "07### ######", "07### ### ###", "020 #### ####", "(0####) ######", "0#### ######", "0### ### ####",
    "+49 ### #######", "+49 (0)## #####-###", "+49 (0)### ######", "+49 ## ########", "0049 ## ##### ###", "0049 ### #######", "0##/######", "0##/#####-##", "0### ######", "0### #######", "0## ##### ###", "0##-#######", "+43 # #######", "+41 ## ### ## ##",
    "+33 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "0033 # ## ## ## ##", "+34 ### ### ###", "+34 ### ## ## ##", "6## ### ###", "6## ## ## ##", "9# ### ## ##", "9## ### ###", "6##-###-###", "600 ### ###", "+39 ### #######", "+39 0# #### ####", "3## #######", "+351 9## ### ###", "+31 6 ########", "06-########", "+32 4## ## ## ##", "+46 7#-### ## ##", "+47 ### ## ###", "+48 ### ### ###", "+420 ### ### ###", "+7 ### ###-##-##", "8 (###) ###-##-##", "+90 5## ### ## ##",
    "090-####-####", "080-####-####", "0#-####-####", "03-####-####", "+81 ## #### ####", "+81-3-####-####", "0120-###-###", "+86 1## #### ####", "1## #### ####", "010-####-####", "+82 10-####-####", "+91 ##### #####", "+91-##########", "+61 4## ### ###", "04## ### ###", "+27 ## ### ####", "+55 ## #####-####", "(##) #####-####", "+52 ## #### ####", "+234 ### ### ####", "+## ## #### ####", "+### ## ### ####", "+## ##########",
]
_TITLES = "Quick Start;Data Frame Basics;Getting Started;Advanced Topics;Release Notes;Command Line Tools;Query Planner;Visual Editor;Data Lake;Machine Learning;New York;Los Angeles;San Francisco;Monday Morning;Control Panel;Style Guide;Spring Sale;Battery Saver;Night Mode;Star Chart;Table Of Contents;Power Point;Open Street Map;Erste Schritte;Guía Rápida;Black Friday;World Cup;Red Cross;United Nations;South Africa;Central Park;Golden Gate;Big Ben;Apache Spark;Visual Studio;Common Lisp;Middle Ages;Blue Whale;Happy Birthday;Thank You;Good Morning;Buenos Aires;Frankfurt am Main;Guten Morgen;Buenas Tardes;Artificial Intelligence;Terms Of Service;Privacy Policy;Google Maps;Final Report;Project Plan;User Guide;Key Findings;Next Steps;Code Review;Unit Tests".split(";")
_HEADINGS = "Summary Index Prompt Archive Timeline Header Footer Notes Overview Appendix Introduction Glossary Changelog Usage Install Options Contents Results Discussion Zusammenfassung Einleitung Anhang Übersicht Resumen Índice Anexo Conclusión Abstract Motivation Background Requirements Examples Features Roadmap License Download Support Fazit Ausblick Ziele Objetivos Introducción Ingredients Directions Homework Agenda Budget Weather Sports".split()
# Everyday words, and frames that make sentences of them: N noun, V verb, A adjective, B adverb, T time or place, # a number.
EVERYDAY = {
    "en": (
        "bread window carpet umbrella teacher nurse cousin farmer driver neighbour painter lawyer soldier village winter letter river story answer question garden kitchen bottle ticket engine wheel bicycle lamp pillow blanket mirror shelf drawer basket bucket ladder hammer shovel rope candle clock picture song dance market harbour bridge tunnel island forest mountain valley desert cloud storm thunder shadow colour shape size weight price offer reason problem idea plan change rule law vote newspaper poem novel chapter page verse teaspoon onion carrot potato cabbage pepper lemon cherry grape apple peach plum walnut almond barley wheat oats rice soup sauce cheese butter honey sugar coffee kettle oven stove dish plate spoon knife fork cup glass jar lid soap towel brush comb coat scarf glove boot button pocket thread needle wool cotton silk leather horse sheep goat rabbit pigeon sparrow pupil doctor uncle singer sailor wallet mailbox doorbell fence stairs balcony elevator suitcase passenger ferry tram tractor sandwich menu recipe concert rehearsal museum holiday exam homework library receipt printer keyboard screen folder password network".split(),
        "buy sell bring carry clean close cook count cover cross cut draw drop empty fill find fold follow forget guard hang heat help hide hold keep leave lend lift light load lock lose make mark measure mend mix move open order pack paint pay plant polish pour press print pull push read remove repair replace return roll save sew shake share show sign sort spill start stir stop store study sweep switch test throw tie touch trim turn wait wash water weigh wipe wrap write check bake borrow choose dance dig dream drive earn feed gather greet invite knock laugh listen meet paddle practise promise ride sing sit skate speak spend steal teach touch visit wake".split(),
        "old new small large heavy light warm cold dry wet clean dirty empty full open quiet loud slow quick bright dark soft hard sweet sour bitter fresh stale plain fancy narrow wide deep shallow steep flat round square straight broken rusty wooden golden silver grey brown yellow purple strange common rare cheap costly useful useless happy sad tired hungry careful careless clever lazy brave shy polite rude honest modest patient early late lonely noisy sleepy slippery sticky sturdy thirsty ugly wild wise".split(),
        "slowly quickly quietly gladly rarely often always twice again briefly safely loosely firmly neatly roughly plainly promptly usually carefully gently suddenly later soon almost together alone outside upstairs downtown".split(),
        "in the morning;after lunch;before winter;last week;next year;on the bus;under the table;near the station;at night;over the weekend;during the meeting;in spring;behind the house;on the roof;at the market;by the river;in the attic;every day;on Sunday;in August;for an hour".split(";"),
        ["The A N Vs the N B.", "T the N was A, and nobody knew where the N had gone.", "Do not V the N; it is still A.", "I wanted to V # Ns, but I only found #.", "Where did you put the A N?", "There is a A N T, and the N is A.", "A A N is better than a A N.", "Somebody has to V the N B.", "We V the N because the N is A.", "Is the N always so A T?", "She said that the N would V T.", "He could V a N B, as his father did.", "# Ns and # Ns were left T.", "Have you ever seen a N V a N?", "My N is as A as your N.", "N, N and N", "Please V the N T and tell me how it went.", "They used to V the N T.", "The N of the N was A and A.", "How many Ns can a N V T?", "No N is A enough to V a N.", "# A Ns", "They sold # A Ns T, and # Ns too.", "I saw # A Ns T.", "He can V it B, she cannot.", "V it B or V them T.", "V me a A N!", "Will you V them B?", "it is B A, and so are # A Ns", "We have # A Ns and # A Ns.", "the A A N", "A N B Vs it; # Ns V it too.", "N N", "N V", "A N N T", "N Ns", "do N Ns V A N Ns T?", "about N Ns and N Ns", "His book on N Ns is A.", "Her talk about N Ns T", "N Ns and A N Ns", "What do N Ns V T?", "a note on N Ns for the N", "The N on N Ns is T.", "for N Ns I would V B", "V N.N", "B enough", "it is B enough for N Ns", "A A N is B enough", "The N wants a A N, since the N is A.", "He would rather have a A N.", "from N to N", "N Ns are A"],
    ),
    "de": (
        "Fenster Tisch Stuhl Brief Garten Straße Brücke Fluss Wald Berg Winter Sommer Herbst Frühling Frühjahr Morgen Abend Nacht Küche Keller Dach Wand Lampe Decke Kissen Spiegel Regal Schublade Korb Eimer Leiter Hammer Schaufel Seil Kerze Uhr Bild Lied Markt Hafen Insel Wolke Sturm Schatten Farbe Form Größe Preis Angebot Grund Frage Antwort Idee Plan Regel Gesetz Zeitung Gedicht Kapitel Seite Wohnung Treppe Zaun Klingel Koffer Fähre Straßenbahn Speisekarte Konzert Probe Museum Urlaub Hausaufgabe Bücherei Quittung Geburtstag Nachbarschaft Werkstatt Kühlschrank Zwiebel Kartoffel Kohl Apfel Kirsche Pflaume Suppe Käse Butter Honig Zucker Kaffee Ofen Teller Löffel Messer Gabel Tasse Glas Dose Seife Handtuch Bürste Mantel Schal Handschuh Knopf Faden Nadel Wolle Pferd Schaf Ziege Taube Lehrer Nachbarin Bäcker Fahrer Kollegin Drucker Tastatur Bildschirm Ordner Passwort Zug Bahnhof Fahrplan".split(),
        "kaufen bringen tragen putzen schließen kochen zählen schneiden zeichnen füllen finden falten folgen vergessen hängen helfen halten lassen leihen heben laden verlieren machen messen mischen bewegen öffnen bestellen packen malen bezahlen pflanzen gießen drucken ziehen schieben lesen entfernen reparieren ersetzen rollen sparen nähen teilen zeigen sortieren beginnen rühren lagern testen werfen binden drehen warten waschen wiegen schreiben backen wählen tanzen graben träumen fahren füttern sammeln grüßen einladen klopfen lachen singen sitzen sprechen besuchen wecken lernen".split(),
        "alt neu klein groß schwer leicht warm kalt trocken nass sauber leer voll offen leise laut langsam schnell hell dunkel weich hart süß sauer frisch schlicht schmal breit tief flach rund gerade kaputt rostig seltsam billig teuer nützlich müde vorsichtig klug faul mutig höflich ehrlich geduldig früh spät einsam laut schläfrig rutschig klebrig stabil durstig hässlich wild weise".split(),
        "langsam leise gern selten oft immer zweimal wieder kurz sicher ordentlich grob meist vorsichtig plötzlich bald fast zusammen draußen oben".split(),
        "am Morgen;nach dem Essen;vor dem Winter;letzte Woche;nächstes Jahr;im Bus;unter dem Tisch;am Bahnhof;nachts;am Wochenende;in der Sitzung;im Frühling;hinter dem Haus;auf dem Dach;am Markt;am Fluss;auf dem Dachboden;jeden Tag;am Sonntag;im August".split(";"),
        ["Der N war so A, dass keiner mehr schlafen konnte.", "T gehen wir zum N.", "Man sieht den N kaum, so A ist die N.", "Ein A N steht T.", "Wo ist denn die A N?", "Die N gehört meiner N.", "Er mag weder N noch N.", "Ohne N kann man nicht V.", "Sie will den N B V.", "# Ns kosten mehr als ein N.", "Das ist ein N und kein N.", "Hast du schon einmal eine N V sehen?", "N, N und N", "Früher konnte man hier T V.", "Mein N ist A, deine N auch.", "Kommt die N heute noch?", "Niemand weiß, wem der N gehört.", "# A Ns", "Er kann es B V.", "T waren # A Ns da.", "der N wirkt A", "Für N braucht man # N.", "Für Ns ist es A.", "Mit N geht es B.", "Bei N und N bin ich A.", "Zu N passt N.", "Im N liegt # mal N.", "Vor N hat er Angst.", "N.", "Wegen N und N: N", "Statt N lieber N V", "Den N in # Ns V.", "mit # Ns oder # Ns", "in # Ns", "nach # Ns T", "N auf # Ns", "eine N V", "A und A"],
    ),
    "es": (
        "ventana mesa silla carta jardín calle puente río bosque montaña invierno verano otoño primavera mañana noche cocina sótano techo pared lámpara manta espejo estante cajón cesta cubo escalera martillo pala cuerda vela reloj cuadro canción mercado puerto isla nube tormenta sombra color forma tamaño precio oferta razón pregunta respuesta idea plan regla ley periódico poema capítulo página escalón valla timbre maleta barco tranvía menú concierto ensayo museo vacaciones deberes biblioteca recibo cumpleaños taller nevera cebolla patata manzana cereza ciruela sopa queso miel azúcar café horno plato cuchara cuchillo taza vaso jabón toalla abrigo bufanda botón hilo aguja lana caballo oveja paloma maestro vecina panadero tren estación".split(),
        "comprar traer llevar limpiar cerrar cocinar contar cortar dibujar llenar encontrar doblar seguir olvidar colgar ayudar dejar prestar levantar cargar perder medir mezclar mover abrir pedir pintar pagar plantar regar imprimir leer quitar reparar guardar coser compartir mostrar ordenar empezar probar tirar girar esperar lavar pesar escribir hornear elegir bailar cavar soñar conducir saludar invitar reír cantar hablar visitar despertar aprender".split(),
        "viejo nuevo pequeño grande pesado ligero caliente frío seco limpio vacío lleno abierto lento rápido claro oscuro blando duro dulce fresco sencillo estrecho ancho hondo redondo recto roto raro barato caro útil cansado listo valiente honesto paciente solo ruidoso pegajoso fuerte feo salvaje sabio".split(),
        "despacio rápido a menudo siempre dos veces otra vez con cuidado pronto casi juntos fuera arriba".split(),
        "por la mañana;después de comer;antes del invierno;la semana pasada;en el autobús;bajo la mesa;cerca de la estación;por la noche;el fin de semana;en primavera;detrás de la casa;en el tejado;en el mercado;junto al río;todos los días;el domingo;en agosto".split(";"),
        ["El N estaba tan A que nadie pudo dormir.", "T vamos al N.", "Hay un N A T.", "¿Dónde está la N A?", "La N es de mi N.", "No le gusta ni el N ni la N.", "Sin N no se puede V.", "Quieren V el N B.", "# Ns cuestan más que una N.", "Esto es un N y no una N.", "¿Has visto alguna vez V a una N?", "N, N y N", "Antes se podía V aquí T.", "Mi N es A y tu N también.", "Nadie sabe de quién es el N.", "# Ns As", "Puede V el N B.", "T había # Ns As.", "el N parece A", "A y A", "N A"],
    ),
    "ja": (
        "天気 電車 新聞 写真 映画 音楽 料理 野菜 果物 牛乳 冷蔵庫 洗濯機 掃除機 自転車 飛行機 駅前 図書館 美術館 病院 学校 教室 宿題 試験 会議室 書類 名刺 手帳 日記 辞書 地図帳 予約 切符 荷物 封筒 切手 財布 眼鏡 帽子 手袋 毛布 枕 机 椅子 本棚 窓 玄関 階段 屋根 庭 公園 海岸 山道 温泉 旅館 食堂 喫茶店 弁当 味噌汁 焼き魚 卵 砂糖 塩 醤油 パン チーズ コーヒー テーブル カーテン ランプ ドア エレベーター カレンダー ノート ペン はさみ 歯ブラシ 石けん タオル 猫 犬 鳥 金魚 花瓶 植木鉢 種 季節 台風 雪 雷 空気 時間 値段 約束 理由 問題 計画 練習 試合 選手 先輩 店員 運転手 大家 近所 隣人 家族 友達 子供 お客 単語 文章 表紙 目次 索引 段落 見出し 一覧 棚卸し 領収書 時刻表 献立 掲示板 説明書 申込書 報告書".split(),
        "買う 売る 運ぶ 洗う 閉める 開ける 数える 切る 描く 探す 畳む 忘れる 手伝う 貸す 持ち上げる 測る 混ぜる 動かす 注文する 払う 植える 押す 引く 読む 直す 取り替える 縫う 見せる 並べる 始める 試す 投げる 結ぶ 待つ 書く 調べる 選ぶ 習う 歌う 掃除する 片付ける 借りる 送る 届ける 覚える 確かめる 整理する".split(),
        "古い 新しい 小さい 大きい 重い 軽い 温かい 冷たい 汚い 静かな 速い 遅い 明るい 暗い 柔らかい 硬い 甘い 苦い 狭い 広い 深い 浅い 丸い 変な 安い 高い 便利な 元気な 親切な 長い 短い 難しい 簡単な 細かい".split(),
        "ゆっくり 早く 静かに たまに いつも もう一度 しっかり 急に すぐ 一緒に 外で 二階で".split(),
        "朝 昼休みに 夕方 冬の前に 先週 来年 バスの中で 机の下で 駅の近くで 夜中に 週末に 春に 家の裏で 屋根の上で 市場で 川のそばで 毎日 日曜日に 八月に 朝のうちに 食後に 雨の日は 休みの日は".split(),
        ["TNをV。", "NはAですが、Nはそうでもありません。", "Aは言えないが、NのNは立派だった。", "TNとNがNに置いてあった。", "BNをVつもりです。", "NをVのはTに限ります。", "#つのNを用意してください。", "NについてNに#ページ書いてあります。", "どうしてNはAのですか。", "NやNは要りません。", "TAN", "NのNへ行くと、ANがありました。", "N、N、N", "Tは、Nを見るだけにします。", "TにNがAと聞いた。", "NをVなら、まずNをVこと。", "Nは#冊あります。"],
    ),
}
#: Letters of other scripts that look like Latin ones, and joined letters; texts hold them by mistake.
_LOOKALIKES = dict(zip("aeopcxyijsABEHKMOPTX", "аеорсхуіјѕАВЕНКМОРТХ")) | {"o ": "ο "}
_JOINED = (("ffi", "ﬃ"), ("ffl", "ﬄ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"))
_COMMON = "the a of to in for with and on by at from that this list table file page line value number order result report report text name label date time user group item field record part code data".split()


class Maker:
    """Makes labelled texts; every method that gives personal information marks it as ``[[kind|text]]``."""

    def __init__(self, fillers: dict[str, list[str]], seed: int):
        self.r = random.Random(seed)
        self.fillers = {k: v for k, v in fillers.items() if v}
        self.languages = list(self.fillers)
        self.words = sorted({w for s in self.fillers.get("en", []) for w in re.findall(r"\b[a-z]{3,12}\b", s)}) or _COMMON
        # Characters of the Japanese sentences, and any others.
        self.kanji = sorted({c for t in self.fillers.get("ja", []) for c in t if "\u4e00" <= c <= "\u9fff"}) + [chr(c) for c in range(0x4E00, 0x9000, 23)]

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def digits(self, pattern: str) -> str:
        """``#`` a digit, ``A`` a capital letter."""
        return "".join(self.pick("0123456789") if c == "#" else self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in pattern)

    # -- names

    def invented(self, most: int = 3) -> str:
        """A word that could be a name of somewhere."""
        s = "".join(self.pick(_ONSETS) + self.pick(_VOWELS) + self.pick(_CODAS) for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.6:
            s += self.pick(_ENDINGS)
        return (s if len(s) > 2 else s + "on").capitalize()

    def surname(self, family: list[str]) -> str:
        x = self.r.random()
        s = self.invented() if x < 0.45 else self.pick(family)
        if x > 0.95:
            s += "-" + self.pick(family)
        elif x > 0.92:
            s += " " + self.pick(family)
        elif x > 0.90:
            s = self.pick(["van", "von", "de", "de la", "del", "di", "Mc", "Mac", "O'", "D'", "al-", "bin", "St. "]) + (" " if self.r.random() < 0.6 else "") + s
            s = re.sub(r"(Mc|Mac|O'|D'|al-) ", r"\1", s)
        return s

    def person(self) -> tuple[str, str]:
        given, family = PEOPLE[self.pick(list(PEOPLE))]
        if self.r.random() < 0.06:  # names that are ordinary words
            family = [w.capitalize() for w in (self.pick(EVERYDAY["en"][0]), self.pick(_NATURE))]
            return (self.pick(given) if self.r.random() < 0.5 else self.pick(_NATURE).capitalize()), self.pick(family)
        first = self.invented(2) if self.r.random() < 0.3 else self.pick(given)
        return first, self.surname(family)

    def east_asian(self) -> str:
        x = self.r.random()
        if x < 0.62:
            kanji = self.kanji if self.r.random() < 0.55 else _KANJI_FAMILY
            family = "".join(self.pick(kanji) for _ in range(2 if self.r.random() < 0.9 else self.pick([1, 3])))
            given = self.pick(_KANA_GIVEN) if self.r.random() < 0.45 else "".join(self.pick(_KANJI_GIVEN) for _ in range(self.pick([1, 2, 2, 2, 3])))
            if self.r.random() < 0.1:
                given = "".join(self.pick("アイウエオカキクケコサシスセソタチツテトナニノハヒフホマミムメモヤユヨラリルレロ") for _ in range(self.r.randint(2, 4)))
            return f"{family}{self.pick(['', ' ', chr(0x3000)])}{given}"
        if x < 0.8:
            return self.pick(_CHINESE[0]) + "".join(self.pick(_CHINESE[1]) for _ in range(self.r.randint(1, 2)))
        return self.pick(_KOREAN[0]) + "".join(self.pick(_KOREAN[1]) for _ in range(2))

    def name(self, language: str = "") -> str:
        if language == "ru" or not language and self.r.random() < 0.04:
            n = f"{self.pick(_RUSSIAN[0])} {self.pick(_RUSSIAN[1])}"
        elif language == "east" and self.r.random() < 0.75 or not language and self.r.random() < 0.03:
            n = self.east_asian()
        else:
            first, last = self.person()
            x = self.r.random()
            if x < 0.38:
                n = f"{first} {last}"
            elif x < 0.47:
                n = f"{first}-{self.person()[0]} {last}"
            elif x < 0.57:
                n = f"{last.upper()}, {first}" if self.r.random() < 0.7 else f"{last}, {first}"
            elif x < 0.715:
                n = f"{first} {last}".lower()
            elif x < 0.75:
                n = f"{first[0]}. {last}" if self.r.random() < 0.8 else f"{first[0]}. {self.pick('ABCDEGHJKLMPRST')}. {last}"
            elif x < 0.82:
                n = f"{first} {self.pick('ABCDEFGHJKLMNPRSTW')}. {last}"
            elif x < 0.96:
                n = f"{self.pick(_WORD_TITLES)} {last if self.r.random() < 0.75 else first + ' ' + last}"
            elif x < 0.98:
                n = f"{first} {self.person()[0]} {last}"
            else:
                n = f"{first} {last}".upper()
        return f"[[name|{n}]]"

    # -- the other kinds

    def ascii(self, s: str) -> str:
        return "".join(c for c in s.lower() if c.isascii() and c.isalnum()) or "mail"

    def email(self, language: str = "") -> str:
        first, last = map(self.ascii, self.person())
        w = self.pick(self.words)
        local = self.pick([f"{first}.{last}", f"{first}-{last}", f"{first}_{last}", f"{first[0]}{last}", f"{first}{last[0]}", f"{last}+{w}", f"{first}+{w}", f"{first}_{self.digits('##')}", f"{last}{self.digits('#')}", f"{first}{self.digits('####')}", first, last, f"{last}.{first}", self.pick(_LOCAL_WORDS), f"{w}.{self.pick(self.words)}"])
        names = [self.pick(["mail", "post", "mx", "smtp", "corp", "eu", "staff"])] if self.r.random() < 0.25 else []
        names.append(self.pick([self.pick(_DOMAIN_WORDS) + self.pick(_DOMAIN_WORDS), self.pick(_DOMAIN_WORDS), self.ascii(self.invented()), f"{self.pick(_DOMAIN_WORDS)}-{self.pick(_DOMAIN_WORDS)}", "gmail", "outlook"]))
        tld = self.pick(_TLDS)
        domain = ".".join([*names, tld])
        x = self.r.random()
        if x < 0.42:
            e = f"{local}@{domain}"
        elif x < 0.50:
            e = f"{local}@{domain}".upper()
        elif x < 0.60:
            e = f"{local}{chr(0xFF20)}{domain}"
        elif x < 0.68:
            e = f"{local}@{chr(self.pick([0x200B, 0x200C, 0x2060]))}{domain}"
        elif x < 0.71:
            e = f"{local} @ {domain}"
        elif x < 0.78:
            e = f"{local}{self.pick(['(at)', ' (at) ', '[at]', '{at}'])}{domain}"
        elif x < 0.87:
            dot = self.pick([" [dot] ", " (dot) ", "[dot]"])
            e = f"{local} {self.pick(['[at]', '(at)'])} {domain.replace('.', dot)}"
        else:
            e = f"{local} at {domain.replace('.', ' dot ')}"
        mark = f"[[email|{e}]]"
        return self.pick([mark, mark, mark, mark, f"<{mark}>", f"mailto:{mark}", f"({mark})"])

    def phone(self, language: str = "") -> str:
        p = self.pick(_PHONES)
        # The first digit of a group of an area is seldom 0 or 1.
        p = self.digits(p if self.r.random() < 0.5 else p.replace("###", self.pick("23456789") + "##", 1))
        x = self.r.random()
        if x < 0.10:
            p = p.replace(" ", chr(self.pick([0xA0, 0x202F])))
        elif x < 0.18:
            p = p.replace("-", chr(self.pick([0x2010, 0x2011, 0x2013])))
        elif x < 0.24:
            p = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() and self.r.random() < 0.8 else c for c in p)
        if p.startswith("tel:"):
            return f"tel:[[phone|{p[4:]}]]"
        return f"[[phone|{p}]]"

    def id_number(self, language: str = "") -> str:
        label, forms = self.pick(_LABELS)
        n = self.digits(self.pick(forms))
        if self.r.random() < 0.06:
            n = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in n)
        if label and self.r.random() < 0.15:
            label = self.pick([label.upper(), label.strip() + ": ", label.strip() + " number ", label.strip() + " is ", label.capitalize()])
        return f"{label}[[id_number|{n}]]"

    def street(self) -> str:
        x = self.r.random()
        if x < 0.55:
            s = (self.pick(_NATURE) + self.pick(_PLACE)).capitalize()
        elif x < 0.75:
            s = self.pick(_NATURE).capitalize()
        elif x < 0.9:
            s = self.invented(2)
        else:
            s = self.pick(["Martin Luther King", "Main", "First", "2nd", "5th", "High", "Church", "Park", "Station", "St. James", "Abbey"])
        return s

    def town(self) -> str:
        x = self.r.random()
        t = (self.pick(_NATURE) + self.pick(_PLACE)).capitalize() if x < 0.4 else self.invented(2) if x < 0.6 else self.pick(_CITIES)
        if x < 0.06:
            t += self.pick(["-on-Sea", "-upon-Tyne", "-under-Lyne", " St Mary", "-le-Moors", "-by-the-Water"])
        elif x > 0.96:
            t = self.pick(["Port ", "Saint ", "New ", "Port-", "Fort ", "Mount "]) + t
        return t

    def german_town(self) -> str:
        return self.pick(_GERMAN_TOWNS[0]) + self.pick(_GERMAN_TOWNS[1]) + self.pick(["", "", "", "heim", "burg"])

    def address(self, language: str = "") -> str:
        r, d, w = self.r, self.digits, self.pick
        n = str(r.randint(1, 4999 if r.random() < 0.6 else 300))
        if language == "east":
            k = lambda: "".join(w(_JAPANESE_TOWN) for _ in range(r.randint(1, 3)))
            where = w(["東京都", "大阪府", "京都府", "北海道", k() + "県", k() + "県", ""]) + k() + w(["市", "市", "区", "郡", "町"]) + k() + w(["町", "町", "", "台", "区"])
            a = where + d(w(["#-#-##", "#-##-#", "#-#-#", "##-#", "#丁目#番#号", "#丁目##番#号", "#丁目#番##号", "#丁目##番##号", "###番地", "#丁目#-#"]))
            if r.random() < 0.15:
                a = f"〒{d('###-####')} " + a
            if r.random() < 0.12:
                a = w(["北京市", "上海市", "广州市", "成都市"]) + k() + "区" + k() + w(["路", "街"]) + d("###号")
            return f"[[address|{a}]]"
        street, city, kind = self.street(), self.town(), w(_STREET_KINDS)
        zip_ = w([d("AA #####"), d("#####"), d("AA #####"), d("A# #AA"), d("AA# #AA"), d("AA## #AA"), d("AA #####-####"), ""])
        tail = w([f", {city}, {zip_}", f", {city} {zip_}", f", {city}", "", f"\n{city} {zip_}", f"\n{city}, {zip_}", f", {city}, {zip_}"]).rstrip(" ,")
        x = r.random()
        if x < 0.30:
            a = f"{n}{w(['', '', '', 'a', 'B'])} {street} {kind}{tail}"
        elif x < 0.40:
            a = f"{n} {street} {kind}{w([' ', ', '])}{w(['Apt #', 'Apt ', 'Suite ', 'Unit ', '#', 'Apt. ', 'Flat '])}{d(w(['#', '##', '###', '#A']))}{tail}"
        elif x < 0.47:
            a = f"{w(['Flat', 'Apartment', 'Unit', 'Suite'])} {d(w(['#', '##', '#A']))}, {n} {street} {kind}{tail}"
        elif x < 0.52:
            a = f"c/o {w(['the office', 'reception', 'the club', 'the school', self.invented(2)])}\n{n} {street} {kind}\n{city} {zip_}".rstrip()
        elif x < 0.58:
            a = f"{n} {street} {w(['street', 'street', 'road', 'avenue', 'lane', 'drive', 'st', 'rd'])}{w(['', ', ' + city])}".lower()
        elif x < 0.63:
            a = f"{w(['P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box', 'p.o. box'])} {n}{w(['', f', {city}', f', {city} {zip_}', f', {city}, {zip_}'])}".rstrip(" ,")
        elif x < 0.70:
            a = f"{w(_GERMAN_TREES)}{w(['straße', 'straße', 'str.', 'weg', 'allee', 'gasse', 'ring', 'platz', 'damm', 'ufer'])} {d(w(['#', '##', '###']))}{w(['', '', 'a', ' b', 'c'])}{w([', ', ', ', ' in ', chr(10), ', D-'])}{d('#####')} {w([self.german_town(), self.german_town(), w(_CITIES)])}"
        elif x < 0.73:
            a = f"{w(['Am', 'An der', 'Im', 'Auf dem', 'Zum', 'Unter den'])} {w(['alten Tor', 'Markt', 'Bach', 'Weinberg', 'Rathaus', 'Hang', 'Linden', 'Mühle', 'Kirchplatz', 'Hafen', 'Sportplatz'])} {d(w(['#', '##']))}{w([', ', chr(10), ' in '])}{d('#####')} {self.german_town()}"
        elif x < 0.75:
            a = f"{w([w(_GERMAN_TREES) + 'straße ' + d('##'), 'Postfach ' + d('## ## ##'), 'Postfach ' + d('####')])}{w(['', ', ' + d('#####') + ' ' + self.german_town()])}"
        elif x < 0.84:
            a = f"{w(['Calle', 'Calle de', 'C/', 'Avenida de', 'Avda. de', 'Av.', 'Plaza de', 'Paseo de', 'Camino de', 'Ronda de', 'C/ de'])} {w(_SPANISH_STREETS)}{w([' ', ', ', ' nº ', ', nº '])}{d(w(['#', '##', '###']))}{w(['', ', ' + d('#') + 'º ' + w('ABCD'), ', ' + d('#') + 'º ' + w(['izda.', 'dcha.', 'izq.', 'centro']), ', bajo', ', piso ' + d('#')])}{w(['', ', ' + self.town(), ', ' + d('#####') + ' ' + w(_CITIES), ', ' + w(['Villa', 'Puebla', 'Peña', 'Torre', 'Castro']) + w(['nueva', 'real', 'blanca', 'verde', 'seca', ' del Río', ' de la Sierra', ' del Monte'])])}"
        elif x < 0.855:
            a = f"{w(['apartado de correos', 'Apartado', 'Apdo.', 'boîte postale', 'BP', 'Casella postale', 'Postbus'])} {d(w(['###', '####', '##']))}{w(['', ', ' + self.town()])}"
        elif x < 0.91:
            a = f"{d(w(['#', '##', '###']))}{w(['', ' bis', ','])} {w(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse'])} {w(_FRENCH_STREETS)}{w(['', ', ' + d('#####') + ' ' + w(_CITIES), chr(10) + d('#####') + ' ' + w(_CITIES)])}"
        elif x < 0.95:
            a = f"{w(['Via', 'Viale', 'Piazza', 'Corso', 'Rua', 'Avenida', 'Largo'])} {w(_ITALIAN_STREETS)}{w([' ', ', ', ' n. '])}{d(w(['#', '##', '###']))}{w(['', ', ' + d('#####') + ' ' + w(_CITIES), ', ' + w(_CITIES)])}"
        else:
            a = f"{self.invented(2)}{w(['straat', 'laan', 'gracht', 'weg', 'gatan', 'vägen', 'veien', 'vej', 'plein'])} {d(w(['#', '##', '###']))}{w(['', ', ' + d('#### AA ') + w(_CITIES), ', ' + d('### ## ') + w(_CITIES)])}"
        return f"[[address|{a}]]"

    # -- sentences

    def mention(self) -> str:
        """A sentence with personal information."""
        kind = self.pick(["name", "name", "name", "name", "name", "name", "email", "phone", "id_number", "id_number", "address", "address"])
        make = getattr(self, kind)
        x = self.r.random()
        if x < 0.13:
            s = self.pick(MENTIONS[kind][0])
            language = "ru" if re.search(r"[а-яА-Я]", s) else "east"
            return s.format(make(language))
        if x < 0.26 and kind != "id_number":
            # Anywhere in a sentence that says something else.
            words = self.filler().split(" ")
            k = self.r.randint(0, len(words))
            return " ".join([*words[:k], make() + self.pick(["", "", ",", ":", ";"]), *words[k:]])
        if x < 0.32:
            return make() + self.pick(["", "", "."])
        s = self.pick(MENTIONS[kind][1]).format(make())
        if x > 0.97 and "\n" not in s:
            s = s[0].lower() + s[1:]
        return s

    def filler(self) -> str:
        """A sentence of public prose or of everyday words, East Asian scripts and English more often."""
        if self.r.random() < 0.45:
            return self.plain()
        language = self.pick(["en", "en", "en", "ja", "ja", "de", "es", *self.languages])
        return self.pick(self.fillers.get(language) or self.fillers[self.languages[0]])

    def plain(self) -> str:
        """A sentence of everyday words."""
        nouns, verbs, adjectives, adverbs, times, frames = EVERYDAY[self.pick(["en", "en", "en", "de", "de", "es", "ja", "ja"])]
        odd = nouns is EVERYDAY["en"][0] and self.r.random() < 0.5  # words of all kinds, not only everyday ones
        sets = {"N": nouns, "V": verbs, "A": adjectives, "B": adverbs, "T": times}

        def word(m: re.Match) -> str:
            if m[0] == "#":
                return str(self.r.randint(1, 999 if self.r.random() < 0.2 else 99))
            if m[0] == "N" and nouns is EVERYDAY["de"][0] and self.r.random() < 0.4:
                return self.pick(nouns) + self.pick(["", "", "s", "n"]) + self.pick(nouns).lower() + self.pick(["", "n", "en"])  # a compound
            return self.pick(self.words) if odd and m[0] in "NVA" and self.r.random() < 0.6 else self.pick(sets[m[0]])

        t = re.sub(r"[NVABT](?![A-Za-z]{2})|#" if nouns is EVERYDAY["ja"][0] else r"\b[NVABT](?=s?\b)|#", word, self.pick(frames))
        return t[0].upper() + t[1:]

    def disguised(self, s: str) -> str:
        """``s`` with some letters of other scripts or joined letters."""
        if self.r.random() < 0.3:
            for plain, joined in _JOINED:
                s = s.replace(plain, joined)
            return s
        share = self.pick([0.1, 0.3, 0.8])
        return "".join(_LOOKALIKES.get(c, c) if self.r.random() < share else c for c in s)

    def phrase(self, n: int) -> str:
        return " ".join(self.pick(self.words) for _ in range(n))

    def trap(self) -> str:
        """A sentence whose numbers, capitals or signs are nobody's."""
        d, w, r = self.digits, self.pick, self.r
        word, place = lambda: w(self.words), self.town
        code = lambda: d(w(["AAA####", "AAA######", "AA-####", "AAA-####", "A#-####", "AAAA###", "A####", "A######", "A######", "A#######", "AA######"]))
        cap = lambda: word().capitalize()
        traps = [
            lambda: f"{w(['Open', 'Read', 'See', 'Start', 'Choose', 'Click', 'About', 'Install', 'Visit'])} {w(_TITLES)}, then {w(_TITLES)}.", lambda: f"The {w(_TITLES)} chapter is short.", lambda: f"We compared {w(_TITLES)} with {w(_TITLES)}.", lambda: w(_TITLES), lambda: w(_TITLES) + ".",
            lambda: f"{'#' * r.randint(1, 4)} {w([w(_HEADINGS), w(_TITLES), cap(), cap() + ' ' + word()])}", lambda: f"{w(_HEADINGS)}\n{w(['===', '---', '======', '-----'])}", lambda: f"== {w(_HEADINGS)} ==", lambda: f"{w(_HEADINGS)}:", lambda: f"**{w(_HEADINGS)}**: {self.phrase(3)}", lambda: f"\\section{{{w(_HEADINGS)}}}", lambda: f"<h2>{w(_HEADINGS)}</h2>", lambda: f"{w(_HEADINGS)}: {self.filler()}", lambda: w(["OK", "Yes.", "No", "Done.", "Sí", "Ja, gern.", "Gracias!", "Danke", "Thanks!", "はい", "了解です。", "Sure.", "Hm.", "Vale", "Perfect.", "Stimmt."]), lambda: cap() + w(["", ".", "!"]),
            lambda: f"Order no. {d('######-#######')} shipped.", lambda: f"{w(['Order', 'File', 'Ticket', 'Vorgang', 'Auftrag', 'Pedido', 'Akte', 'entry', 'file', 'Case', 'Invoice', 'Rechnung', 'Factura', 'item', 'SKU', 'batch', 'issue', 'part no.', 'Expediente'])} {code()}{w(['.', ':', ',', ''])} {self.phrase(4)}", lambda: f"{self.filler().rstrip('.')}, {w(['file', 'entry', 'see', 'siehe Akte', 'Vorgang', 'índice', 'ticket', 'expediente'])} {code()}.", lambda: f"{code()}番の{w(['データ', 'ファイル', '商品', '書類'])}を{d('##')}個{w(['確認', '保存', '注文'])}しました。", lambda: f"{w(['カタログ', '注文', '文書', '品番'])}{code()}には{d('##')}件あります。", lambda: f"{code()} {cap()}", lambda: f"{word()} {code()}", lambda: f"{word()} {code()} {word()}", lambda: f"{self.plain().rstrip('.')} {code()}.", lambda: f"{word()} {d(w(['####-####', '####-#####', '##-####', '########', '###########', '##########']))} {self.phrase(2)}", lambda: f"{w(['the number', 'The number', 'A number like', 'number', 'Die Zahl', 'El número', '数字'])} {d(w(['###########', '#########', '########', '############']))} {w(['is', 'has', 'was', 'ist', 'es', ''])} {self.phrase(3)}", lambda: f"{word()} {d('#')}", lambda: f"{w(['exit', 'return', 'sleep', 'print', 'yield', 'goto', 'level', 'step', 'wait'])} {d(w(['#', '##', '###']))}", lambda: f"{d('#')} {word()}", lambda: f"{d('#')}.", lambda: f"$ {word()} {word()} -{w('abcn')} {d('##')}", lambda: f"if {word()} < {d('##')} and {word()} > {d('##')}: {word()}", lambda: f"ORDER BY {word()} LIMIT {d('##')}", lambda: f"WHERE {word()} <= {d('##')} GROUP BY {word()}", lambda: f"{w(['ports', 'Ports', 'years', 'pages', 'lines', 'rows', 'port', 'range'])} {d(w(['####-####', '###-###', '####']))} {self.phrase(2)}",
            lambda: f"{d('###########')} {word()}s", lambda: f"bug #{d('###')}: C# and F# {self.phrase(3)}", lambda: f"p. {d('###')}/{d('####')}, ll. {d('####')}-{d('####')}", lambda: f"{word()} {d('####')} to {d('####')}", lambda: f"port {d('80##')}, ports {d('1####-1####')}", lambda: f"#{d('####')} fixes #{d('####')}", lambda: f"{w(['Install', 'npm install', 'add'])} {word()}@{d('#.##.#')} first.", lambda: f"Use @{word()} and @{word()}{word()} there.", lambda: f"@{word()} {self.phrase(4)}", lambda: f"git@{word()}-{word()}:{word()}/{word()}.git", lambda: f"git clone git@{word()}.{w(_TLDS)}:{word()}.git", lambda: f"ssh {word()}@{d('10.##.0.##')}",
            lambda: f"The {w([self.invented(2), place(), self.street()])} {w(['Street Market', 'Bridge', 'Lane Festival', 'Road Works', 'Museum', 'Valley', 'Castle', 'River', 'Hotel', 'Institute', 'Theorem', 'Award', 'Street', 'Road bridge', 'Station', 'University', 'method', 'algorithm', 'harbour'])} {w(['opens on Sunday', 'is closed', 'was crowded', 'is north of here', 'won again', 'works well'])}.", lambda: f"{w(['Buses', 'Flights', 'Busse', 'Vuelos'])} {w(['to', 'from', 'nach', 'a'])} {place()} {w(['left early', 'are full', 'fallen aus', 'salen pronto'])}.", lambda: f"{w(['in', 'near', 'from', 'to'])} {place()}, {self.phrase(3)}", lambda: f"{w(['The people of', 'Tourists in', 'Near', 'The beaches of', 'Beyond', 'North of', 'Die Altstadt von', 'En', 'Two villages,'])} {self.invented(2)}{w(['', ' and ' + self.invented(2)])} {self.phrase(5)}.", lambda: f"{word()} in {self.invented(2)} {self.phrase(2)}",
            lambda: f"It happened at 20{d('##')}-0{d('#')}-1{d('#')} {d('09:##')}.", lambda: f"20{d('##')}-{d('0#-1#')} {d('1#:##:##')} [INFO] {word()}: {word()}={d('###')}", lambda: f"{d('1#.0#.20##')}, {d('1#:##')} Uhr", lambda: f"{d('0#/1#/20##')}", lambda: f"on {w(['Monday', 'Friday'])}, {d('1#')} {w(['May', 'March', 'August', 'April', 'June'])} 20{d('##')}", lambda: f"{d('20##年#月1#日')}の{d('##')}ページ", lambda: f"{{\"ts\": {d('17########')}, \"{word()}\": \"{word()}\"}}", lambda: f"ts={d('1############')}", lambda: f"timestamp {d('17########')}",
            lambda: f"ping {d('1##.##.#.###')}", lambda: f"The commit is {''.join(w('0123456789abcdef') for _ in range(r.choice([7, 12, 40])))}.", lambda: f"id {''.join(w('0123456789abcdef') for _ in range(16))}", lambda: f"uuid {''.join(w('0123456789abcdef') for _ in range(8))}-{''.join(w('0123456789abcdef') for _ in range(4))}-4{''.join(w('0123456789abcdef') for _ in range(3))}", lambda: f"{w(['room', 'Room', 'Raum', 'hall', 'floor'])} {d('##')}{w(['', ', building ' + w('ABCD'), ', Building ' + w('ABCDEF'), ', Wing ' + w('AB'), ', Haus ' + d('#')])}", lambda: f"({d('#######')})", lambda: f"（{''.join(chr(0xFF10 + int(c)) for c in d('########'))}）", lambda: f"rows: {d('####')}", lambda: f"done in {d('###')} ms", lambda: f"{d('##')} {word()}s and {d('###')} {word()}s", lambda: d("#########"), lambda: f"total {d('########')} bytes",
            lambda: f"See http://{word()}{word()}.{w(_TLDS)}/{word()}/{d('###')}", lambda: f"https://{word()}.{w(_TLDS)}/{word()}?id={d('######')}&{word()}={d('##')}", lambda: f"The host {word()}-{d('##')}.{word()}.{w(_TLDS)} is down.", lambda: f"www.{word()}{word()}.{w(_TLDS)}", lambda: f"[{self.phrase(2)}](https://{word()}.{w(_TLDS)}/{d('###')})",
            lambda: f"const {word()} = {word()}.filter(x => x.{word()} > {d('##')} && x.{word()} < {d('###')});", lambda: f"def {word()}({word()}, {word()}={d('##')}): return {word()}[{d('#')}]", lambda: f"SELECT {word()}, count(*) FROM {word()} WHERE {word()} > {d('###')};", lambda: f"'''{cap()}''' {self.phrase(3)}", lambda: f"''{self.phrase(2)}'' {word()}", lambda: f"_{cap()}_ {word()}", lambda: f"`{word()}_{word()} --{word()}={d('##')}`", lambda: f"\\cite{{{word()}{d('####')}}} \\emph{{{word()}}}", lambda: f"$x_{d('#')}^2 + \\frac{{{d('##')}}}{{{d('##')}}} = {d('###')}$", lambda: f"A = [[{d('#')}, {d('#')}], [{d('#')}, {d('#')}]]", lambda: f"{d('##')} * {d('###')} = {d('####')}", lambda: f"See [[{cap()}|the {word()}]] for more.", lambda: f"{{{{Infobox {word()}|size={d('##')}|state={word()}}}}}", lambda: f"| {word()} | {d('##')} |\n| {cap()} | {d('##')} |", lambda: f"<tr><td>{word()}</td><td>{d('##')}</td></tr>", lambda: f"<b>{self.phrase(2)}</b> &amp; <i>{word()}</i>", lambda: f"- {self.phrase(4)}\n- {self.phrase(3)}", lambda: f"1. {self.filler()}\n2. {self.filler()}", lambda: f"> {self.filler()}", lambda: f"```{w(['', 'python', 'sql'])}\n{word()} = {word()}({d('##')})\n```", lambda: f"<!-- {word()} -->", lambda: f"<{word()}>", lambda: f"<{word()} {word()}=\"{d('##')}\">", lambda: f"C:\\{word()}\\{word()}\\", lambda: f"/{word()}/{word()}/{word()}.{w(['txt', 'py', 'csv'])}", lambda: f"{word()}_{word()}_id", lambda: f'{{"{word()}": {d("##")}, "{word()}": [[1, 2], [3, 4]]}}',
            lambda: f"The {self.invented(2)} {w(['3000', '9', 'X2', 'Pro', 'mini', d('###0')])} {w(['printer', 'phone', 'drill', 'camera', 'kettle'])} {w(['is on sale', 'costs less', 'broke', 'sells well'])}.", lambda: f"{self.invented(2)} {d('#')} for ${d('##')}", lambda: f"{self.invented(2)} {d('#.#')} is out.", lambda: f"Version {d('#.#.##')} of {d('20##')} is out.", lambda: f"v{d('#.##.#-')}{w(['beta', 'rc', 'alpha'])}{d('#')}", lambda: f"ISBN {d('978-#-###-#####-#')}", lambda: f"ISBN {d('##########')}", lambda: f"{d('#,###.##')} EUR, {d('0#.1#.20##')}", lambda: f"Tracking {d('############')} left the depot.", lambda: f"from ${d('##')} up to ${d('###')}", lambda: f"{d('##.##')} €", lambda: f"¥{d('#,###')}", lambda: f"Flight {d('AA###')} lands at {d('1#:##')}.", lambda: f"{w(['Bus', 'Linie', 'Gate', 'Tram'])} {d('###')} {self.phrase(2)}", lambda: f"IBAN {d('AA## #### #### #### ####')}", lambda: f"{w(['card', 'Visa', 'account'])} {d('#### #### #### ####')}", lambda: f"{d('##.####')}, {d('-#.####')}", lambda: f"DOI 10.{d('####')}/{word()}.{d('####')}", lambda: f"RFC {d('####')}, section {d('#.#')}", lambda: f"chapter {d('##')}, verse {d('#')}", lambda: f"score {d('##')}-{d('##')}", lambda: f"pages {d('###')}-{d('###')}", lambda: f"{d('####-####')}", lambda: f"Nr. {d('####')}", lambda: f"part {d('##')}/{d('##')}",
            lambda: f"{w(['Señal', 'Über', 'Naïve', 'Café', 'Smörgåsbord', 'Jalapeño', 'Garçon', 'Žluťoučký'])} {self.phrase(2)} {d('##')} {w(['crème', 'touché', 'doppelgänger', 'piñata', 'façade', 'éclair', 'über', 'niño'])} {word()}.", lambda: f"{w(['My', 'Our', 'Dear', 'The old', 'Every', 'A', 'Der', 'Die', 'El', 'La'])} {cap()} {self.phrase(4)}.", lambda: f"{cap()} {cap()} {self.phrase(3)}", lambda: f"{w(['User', 'Assistant', 'System', 'Parser', 'Archive', 'Agent', 'Bot'])}: {self.filler()}", lambda: f"{w(['Dear', 'Liebe', 'Estimado', 'Hello', 'Hi'])} {w(['team', 'all', 'customer', 'Kollegen', 'equipo', 'everyone', 'reader'])},", lambda: f"{w(['Best regards', 'Kind regards', 'Viele Grüße', 'Un saludo', 'Cordialement', 'Cheers', 'Mit besten Grüßen', 'Atentamente'])},\n{w(['the team', 'your support', 'das Team', 'el equipo', word()])}", lambda: f"{w(['My boss', 'The nurse', 'Our plumber', 'A stranger', 'The early shift', 'Mein Chef', 'El médico', 'The captain', 'Somebody', 'Everyone else'])} {self.phrase(5)}.", lambda: f"{w(['the address', 'my phone', 'the name', 'an e-mail', 'the passport', 'mein Name', 'el teléfono', '電話', '住所', '名前', 'my address', 'the number'])} {self.phrase(4)}", lambda: f"{self.phrase(3)} <{w(['name', 'email', 'address', 'phone', 'user', 'file'])}> {self.phrase(2)}", lambda: f"{self.plain()} at {self.phrase(2)}, the dot {self.phrase(2)}", lambda: f"from: {self.phrase(2)}", lambda: f"{w(['Contact', 'Phone', 'Name', 'Address', 'Tel.', 'Signed', 'from', 'Firma', 'Unterschrift'])}: {self.phrase(2)}", lambda: f"{w(['written by', 'sent by', 'thanks to', 'ask', 'thank', 'von', 'por', 'gracias a'])} {w(['the', 'a', 'my', 'der', 'el'])} {word()} {self.phrase(2)}",
        ]
        return self.pick(traps)()

    def text(self) -> str:
        out, r = [], self.r
        if r.random() < 0.05:
            return self.trap()
        for _ in range(r.randint(1, 5)):
            x = r.random()
            s = self.mention() if x < 0.42 else self.trap() if x < 0.72 else self.filler()
            y = r.random()
            if x >= 0.42:
                if y < 0.06:
                    s = s.upper()
                elif y < 0.09:
                    s = s.lower()
                elif y < 0.13:
                    s = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else chr(0x3000) if c == " " else c for c in s)
                elif y < 0.19:
                    k = r.randint(0, len(s))
                    s = s[:k] + chr(self.pick([0x200B, 0x200C, 0xAD, 0x2060, 0xFEFF])) + s[k:]
                elif y < 0.23:
                    s = s.replace(" ", chr(self.pick([0xA0, 0x2007, 0x2009, 0x202F, 0x3000])))
                elif y < 0.31:
                    s = self.disguised(s)
                elif y < 0.34:
                    s = "".join(c + (chr(self.pick([0x301, 0x308])) if c in "aeiou" and r.random() < 0.1 else "") for c in s)
            elif y < 0.06:
                s = self.pick(["**{}**", "<p>{}</p>", "> {}", "- {}", "| {} |", "*{}*", "\"{}\"", "({})", "<td>{}</td>", "\\textbf{{{}}}", "1. {}"]).format(s.replace("{", "{{").replace("}", "}}"))
            out.append(s)
            out.append(self.pick([" ", " ", " ", "\n", "\n\n", ""] if out[-1].endswith(("。", ".")) else [" ", " ", "\n", "\n\n"]))
        return "".join(out).rstrip()


_MARKED = re.compile(r"\[\[(name|email|phone|id_number|address)\|(.*?)\]\](?!\])", re.S)


def labelled(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans of a text with marks."""
    out, spans, at, size = [], [], 0, 0
    for m in _MARKED.finditer(marked):
        out.append(marked[at : m.start()])
        size += m.start() - at
        out.append(m[2])
        spans.append((size, size + len(m[2]), m[1]))
        size += len(m[2])
        at = m.end()
    out.append(marked[at:])
    return "".join(out), spans


def tags_of(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        y[a] = TAGS.index("B-" + kind)
        y[a + 1 : b] = TAGS.index("I-" + kind)
    return y


def manual_sentences(language: str) -> list[str]:
    """Sentences of the manual pages of a language ('' is English), layout commands taken off."""
    out: dict[str, None] = {}
    for path in sorted(Path(MANUALS, language).glob("man[1578]/*.gz"))[: 400 if not language else None]:
        try:
            text = gzip.decompress(path.read_bytes()).decode("utf-8", "replace")
        except (OSError, EOFError):
            continue
        text = re.sub(r"\\f[BIRP]|\\f\(..|\\s[-+]?\d|\\&|\\%|\\/", "", re.sub(r"\\-", "-", text))
        for block in re.split(r"\n\s*\n|\n(?:[.'](?!(?:B|I|BR|IR|RB|BI)\b)[^\n]*\n?)+", text):
            flat = " ".join(re.sub(r"(?m)^[.'](?:BR|IR|RB|BI|B|I)\s+", "", block).replace('"', "").split())
            if "\\" not in flat:
                for t in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜÀ-ÝА-Я¿])|(?<=。)", flat):
                    if len(t) > (12 if language[:2] in ("ja", "zh", "ko") else 30) and re.search(r"[.!?。！？]$", t):
                        out[t] = None
    return list(out)


def sentences(folders: list[str], pods: list[str]) -> dict[str, list[str]]:
    """Sentences of public software by language, at most ``SENTENCES`` of each, evenly from all; those that look like a name or a number of somebody are left out."""
    nobody = re.compile(r"\d{4}|[@\uff20]|[Cc]opyright|\b(?:[Ww]ritten|[Aa]uthor|[Mm]aintain|[Tt]hanks|translat)\w*|\b[A-Z]\w+ [A-Z]\w+|©")
    found = {language: messages(folders, language) + manual_sentences(language) for language in LANGUAGES}
    found["en"] = [s for p in pod_paragraphs(pods) for s in re.split(r"(?<=[.!?])\s+", p)] + manual_sentences("")
    out = {}
    for language, texts in found.items():
        good = [t for t in texts if len(t) < 200 and not nobody.search(t)]
        most = SENTENCES * (3 if language == "en" else 1)
        step = max(1, len(good) // most)
        out[language] = good[::step][:most]
    return out


def _batch(tagger: Tagger, maker: Maker, rng: random.Random, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.zeros((WINDOW, batch), np.int32)
    y = np.zeros((WINDOW, batch), np.int64)
    mask = np.zeros((WINDOW, batch), bool)
    for j in range(batch):
        text, spans = labelled(maker.text())
        a = rng.randint(0, max(0, len(text) - WINDOW)) if rng.random() < 0.8 else 0
        n = min(WINDOW, len(text) - a)
        if n <= 0:
            text, spans, a, n = "-", [], 0, 1
        x[:n, j] = tagger.encode(text[a : a + n])
        y[:n, j] = tags_of(text, spans)[a : a + n]
        mask[:n, j] = True
    # A window that begins inside a span has its first tag begin it.
    inside = (y[0] > 0) & (y[0] % 2 == 0)
    y[0, inside] -= 1
    return x, y, mask


def _worker(pipe, tagger: Tagger, fillers: dict[str, list[str]], seed: int, batch: int) -> None:
    maker, rng = Maker(fillers, seed), random.Random(seed + 1)
    while (p := pipe.recv()) is not None:
        tagger.p = p
        pipe.send(tagger.step(*_batch(tagger, maker, rng, batch)))


def train(steps: int, folders: list[str], pods: list[str], batch: int = 48, seed: int = 5, hidden: int = 48, workers: int = 8, first: Tagger | None = None) -> None:
    """Train anew, or go on from ``first``."""
    fillers = sentences(folders, pods)
    print({k: len(v) for k, v in fillers.items()}, "sentences", flush=True)
    if first is None:
        maker, count = Maker(fillers, seed), Counter()
        for _ in range(8000):
            count.update(folded(c) for c in labelled(maker.text())[0])
        first = Tagger(sorted(c for c, n in count.items() if n >= 12 and c not in CLASSES), hidden=hidden)
    tagger = first
    print(len(tagger.alphabet), "characters", flush=True)
    adam = Adam(tagger.p, 0.01)
    pipes = []
    fork = multiprocessing.get_context("fork")
    for k in range(workers):
        ours, theirs = fork.Pipe()
        fork.Process(target=_worker, args=(theirs, tagger, fillers, seed + 100 * (k + 1), batch), daemon=True).start()
        pipes.append(ours)
    began, mean = time.time(), 2.0
    for k in range(steps):
        for p in pipes:
            p.send(tagger.p)
        got = [p.recv() for p in pipes]
        grads = {name: sum(g[name] for _, g in got) / workers for name in got[0][1]}
        rate = 0.012 * min(1.0, (k + 1) / 50) * (0.5 * (1 + np.cos(np.pi * k / steps))) + 1e-4
        adam.apply(grads, rate)
        mean += 0.02 * (sum(loss for loss, _ in got) / workers - mean)
        if k % 100 == 0 or k == steps - 1:
            print(k, round(mean, 5), round(time.time() - began), flush=True)
        if k % 500 == 499 or k == steps - 1:
            MODEL.write_bytes(tagger.dump())
    for p in pipes:
        p.send(None)


def average(paths: list[str]) -> bytes:
    """The model whose weights are the means of those of several states of one training."""
    states = [Tagger.load(Path(p).read_bytes()) for p in paths]
    out = states[0]
    out.p = {k: np.mean([s.p[k] for s in states], axis=0) for k in out.p}
    return out.dump()


if __name__ == "__main__":
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    go_on = "--resume" in sys.argv
    args = [x for x in sys.argv[1:] if x != "--resume"]
    if args[:1] == ["--average"]:
        MODEL.write_bytes(average(args[1:]))
        sys.exit()
    train(int(args[0]) if args else 8000, args[1:] or ["/usr/share/locale"], ["/usr/share/perl", "/usr/lib"], seed=11 if go_on else 5, first=Tagger.load(MODEL.read_bytes()) if go_on else None)
