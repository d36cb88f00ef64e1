"""Made-up labelled documents on which the recogniser of personal data is fitted.

Written from general knowledge of how people write, not from any table: field
labels, prose and decoys are combined at random, and so are names, numbers and
addresses. A name may recur in its document, also where little speaks for it.
"""

from __future__ import annotations

import random

GIVEN = {
    "en": "Alice Andrew Brian Carol Daniel Edward Emma Fiona George Hannah Harry Jack James John Laura Lucy Mark Mary Michael Nancy Oliver Paul Peter Robert Ruth Sarah Simon Susan Thomas Wendy William Grace Henry Kevin Linda Megan Nathan Olivia Philip Rachel Stephen Victoria Walter Zoe Ravi Priya Mohammed Aisha Kenji",
    "de": "Anna Bernd Christa Dieter Elke Frank Günter Hans Ilse Jens Karin Klaus Martin Monika Peter Ralf Sabine Stefan Uwe Wolfgang Jörg Bärbel Heinz Renate Jürgen Ute Matthias Birgit Tobias Katrin",
    "es": "Alejandro Antonio Carmen Elena Fernando Isabel Javier José Juan Luis María Miguel Pablo Rosa Sergio Andrés Mónica Ángel Raúl Beatriz Diego Esteban Gloria Inés Marta Rubén Teresa",
    "fr": "Camille Chloé Claire Émile Émilie François Jean Julien Lucas Marie Nicolas Paul Pierre Sophie Thomas Hélène Cédric Anaïs Bernard Céline Dominique Guillaume Jacqueline Laurent Mathieu Nathalie Olivier",
    "nl": "Anneke Bram Daan Eva Hans Jan Johanna Kees Maria Pieter Sanne Sophie Thijs Willem Anouk Joris An Bart Femke Gerrit Hendrik Ilse Jeroen Lotte Marijke Rutger Wouter",
    "pt": "Ana António Bruno Carlos Fernando Joana José Luís Manuel Maria Miguel Paulo Pedro Rita Sofia Teresa João Beatriz Diogo Filipa Gonçalo Inês Marta Nuno Ricardo Susana Tiago",
    "ru": "Алексей Анна Борис Виктор Дмитрий Екатерина Елена Иван Мария Наталья Николай Ольга Павел Пётр Светлана Сергей Татьяна Юрий Андрей Вера Галина Ирина Константин Михаил Оксана Роман",
}
FAMILY = {
    "en": "Smith Johnson Brown Taylor Wilson Walker Clarke Harris Lewis Young King Wright Green Baker Hill Moore Patel Khan Kim Lee Li Nguyen Murphy Cooper Ward Bennett Krishnamurthy Okafor Tanaka",
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann Schwarz Zimmermann Krüger Köhler",
    "es": "García Martínez López Sánchez Pérez Gómez Fernández Díaz Moreno Muñoz Romero Navarro Torres Ruiz Ortega Castro Vega",
    "fr": "Martin Bernard Dubois Durand Leroy Moreau Laurent Lefebvre Michel Fournier Girard Bonnet Mercier Faure Rousseau Blanchard",
    "nl": "Jansen Bakker Visser Smit Mulder Bos Vos Peters Hendriks Dekker Brouwer Dijkstra Kok Postma Kuipers",
    "pt": "Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Sousa Gonçalves Almeida Carvalho Ribeiro Pinto Teixeira",
}
#: A Russian family name is a stem with an ending.
STEMS_RU = "Иван Петр Кузнец Сокол Поп Лебед Смирн Волк Мороз Новик Гордей Зай Белов Тихон Орл Григор Бел Крыл Медвед Сав Том Фрол Щерб Громов Дорон Жук Казак Лап Мельник Никит"
ENDINGS_RU = "ов ова ев ева ин ина енко ский ская ич цев цева"
STREETS_RU = "Ленина Садовая Лесная Полевая Школьная Зелёная Центральная Набережная Советская Молодёжная Мира Победы Гагарина Пушкина"
#: Words between a given name and a family name.
PARTICLES = {"en": "de|al", "de": "von|von der|zu", "es": "de|de la|del", "fr": "de|du|le", "nl": "van|van der|van den|de", "pt": "da|dos|de|do"}
SURNAMES_ZH = "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 梁 宋 郑 谢 韩 唐 冯 于 董 萧 程 曹 袁 邓 许 傅 沈 曾 彭 吕 苏 卢 蒋 蔡 贾 丁 魏 薛 叶 阎 余 潘 杜 戴 夏 钟 汪 田 任 姜 范 方 石 姚 谭 廖 邹 熊 金 陆 郝 孔 白 崔 康 毛 邱 秦 江 史 顾 侯 邵 孟 龙 万 段 雷 钱 汤 尹 黎 易 常 武 乔 贺 赖 龚 文"
COMPOUND_ZH = "欧阳 司马 上官 诸葛 夏侯 皇甫 慕容 令狐 宇文 长孙 尉迟 公孙 端木 南宫 东方"
GIVEN_ZH = "伟 芳 娜 敏 静 丽 强 磊 军 洋 勇 艳 杰 涛 明 超 秀英 华 建国 志强 晓明 子涵 雨轩 思远 佳怡 嘉树 清扬 明远 一帆 海燕 文博 梓萱 浩然 春梅 立新 玉兰 国栋 婷婷 俊熙 美玲 小明 三丰"
STREETS_ZH = "人民 中山 解放 建设 和平 长江 文化 新华 东风 北京 南京 光明 胜利 友谊 长安 朝阳 青年 迎宾 滨江 花园"

#: What stands before a name, a phone number, an identity number and an address, by language.
LABELS = {
    "en": {
        "N": "Name|Full name|Contact|Contact person|Sender|Recipient|Owner|Assignee|Reviewer|Author|Customer|Patient|Applicant|To|Cc|Attn|Attendee|Maintainer|Editor|Witness|Tenant|Reviewed-by|Signed-off-by|Approved by|Written by|Co-authored-by|user|customer|contact",
        "P": "Phone|Phone number|Mobile|Cell|Fax|Telephone|Tel|Tel.|Office phone|Call|Hotline|WhatsApp|Reach me on|ring|mobile|tel|phone|fax",
        "I": "Passport|Passport no.|Passport number|SSN|Social security no.|Social security number|Tax number|Tax ID|National insurance number|ID card|ID number|Identity card|NI no.|ssn|passport|id|taxpayer number",
        "A": "Address|Home address|Street|Office|Delivery address|Ship to|Billing address|Residence|addr|address|Mailing address|visit us at",
        "E": "Email|E-mail|Mail|Reply-To|mail|email|Contact|write to|user|login",
    },
    "de": {
        "N": "Name|Ansprechpartner|Kontakt|Absender|Empfänger|Bearbeiter|Kundin|Kunde|Verfasser|An|Von|Teilnehmer|Autor|Vertreter|Mieter|Zuständig|Geprüft von|Erstellt von",
        "P": "Telefon|Telefonnummer|Mobil|Handy|Fax|Rufnummer|Tel|Tel.|Durchwahl|Rückruf|erreichbar unter",
        "I": "Ausweisnummer|Reisepass|Passnummer|Personalausweis|Steuernummer|Steuer-ID|Sozialversicherungsnummer|Personalausweis Nr.|Ausweis",
        "A": "Adresse|Anschrift|Wohnort|Straße|Lieferadresse|Rechnungsadresse|Büro|wohnhaft|Postanschrift",
        "E": "E-Mail|Mail|Antwort an|Kontakt|schreiben an",
    },
    "es": {
        "N": "Nombre|Contacto|Remitente|Destinatario|Cliente|Responsable|Autor|Autora|Para|De|Titular|Paciente|Revisado por|Firmado por",
        "P": "Teléfono|Móvil|Tel|Tel.|Fax|Llame al|Celular|Número de contacto",
        "I": "DNI|NIE|Pasaporte|Número de pasaporte|Documento de identidad|NIF|Seguridad social",
        "A": "Dirección|Domicilio|Calle|Envío a|Oficina|Dirección de entrega|residente en",
        "E": "Correo|Correo electrónico|Email|Escriba a",
    },
    "fr": {
        "N": "Nom|Contact|Expéditeur|Destinataire|Client|Cliente|Responsable|Auteur|À|De|Titulaire|Patient|Rédigé par|Relu par|Envoyé par",
        "P": "Téléphone|Portable|Mobile|Tél|Tél.|Fax|Appelez le|Joignable au",
        "I": "Passeport|Numéro de passeport|Carte d'identité|Numéro de sécurité sociale|Sécurité sociale|Numéro fiscal|NIR",
        "A": "Adresse|Domicile|Livraison|Bureau|Adresse postale|demeurant|domicile",
        "E": "Courriel|Mail|E-mail|Écrire à",
    },
    "nl": {
        "N": "Naam|Contactpersoon|Afzender|Ontvanger|Klant|Behandelaar|Auteur|Aan|Van|Huurder|Beoordeeld door|Geschreven door",
        "P": "Telefoon|Telefoonnummer|Mobiel|Tel|Tel.|Fax|Bel|Bereikbaar op",
        "I": "BSN|Burgerservicenummer|Paspoort|Paspoortnummer|Identiteitskaart|Sofinummer|Belastingnummer",
        "A": "Adres|Woonadres|Bezorgadres|Kantoor|Postadres|woont op",
        "E": "E-mail|Mail|Antwoord aan|Stuur naar",
    },
    "pt": {
        "N": "Nome|Contacto|Contato|Remetente|Destinatário|Cliente|Responsável|Autor|Para|De|Titular|Paciente|Revisto por|Escrito por",
        "P": "Telefone|Telemóvel|Celular|Tel|Tel.|Fax|Ligue para|Número de contato",
        "I": "CPF|NIF|Passaporte|Número do passaporte|Bilhete de identidade|Cartão de cidadão|RG|Número fiscal",
        "A": "Morada|Endereço|Residência|Entrega|Escritório|residente na|Endereço de entrega",
        "E": "Correio|E-mail|Email|Escreva para",
    },
    "ru": {
        "N": "Имя|ФИО|Контакт|Отправитель|Получатель|Клиент|Ответственный|Автор|Кому|От кого|Заявитель|Пациент|Проверил|Составил|От|Подпись",
        "P": "Телефон|Тел|Тел.|Моб.|Мобильный|Факс|Звоните|Номер для связи|телефон",
        "I": "Паспорт|Номер паспорта|СНИЛС|ИНН|Удостоверение|Серия и номер|паспорт",
        "A": "Адрес|Место жительства|Доставка|Офис|Проживает|Адрес доставки|адрес",
        "E": "Почта|Эл. почта|Писать на|E-mail",
    },
    "zh": {
        "N": "姓名|联系人|发件人|收件人|客户|负责人|作者|经办人|申请人|患者|审核人|用户|签名|收货人|主讲人|报告人",
        "P": "电话|手机|联系电话|手机号|传真|座机|电话号码|热线",
        "I": "身份证|身份证号|身份证号码|护照|护照号|护照号码|证件号|社保号|税号",
        "A": "地址|住址|家庭地址|收货地址|办公地点|通讯地址|寄往|住在",
        "E": "邮箱|电子邮件|邮件|回复至",
    },
}

#: Running text with personal data.
PROSE = {
    "en": [
        "I had lunch with {N} and we talked about the budget.", "{N} moved to {A} last spring.", "You can reach {N} on {P} after six.", "Could you forward this to {N} ({E})?", "{N} will chair the meeting, {N} takes the minutes.",
        "The parcel went to {A} by mistake.", "According to {N}, the report is late.", "My number changed, it is {P} now.", "Her passport, {I}, expires in May.", "{N} <{E}> wrote:", "{N}, {A}", "{N} ({E})", "{N}, {P}", "Best regards,\n{N}", "Kind regards\n{N}\n{P}",
        "Dear {N},\nthank you for the letter.", "Mr. {N} and Mrs. {N} signed the lease for {A}.", "Prof. {N} gave the lecture.", "Dr. {N} is on holiday.", "Please call {P} or write to {E}.", "{N} joined the team in June.", "We hired {N} as an accountant.",
        "Thanks, {N}!", "For details contact {N} at {E}.", "You may contact {N} or {N}.", "Thanks to {N} for the review.", "a friend of {N} came by", "the desk of {N} is empty", "My neighbour {N} is away.", "Our new colleague {N} comes from {A}.", "my boss {N} agreed", "This is the number of {N}: {I}", "the wife of {N}", "My brother {N} lives at {A}, his phone is {P}.", "It was {N} who found the key.", "they still have my old card {I} on file", "the form lists {I} as my tax number", "my ID number is {I}, keep it private", "the ID on it is {I}", "somebody pasted {I} into the chat", "remove {I} from the list, please", "drop it off at {A} before noon", "we live at {A} now", "{N}\n{A}\n{P}\n{E}", "{N}\n{P}\n{E}", "{N}\n{A}",
        "{N} | {E} | {P}", "| {N} | {A} |", "{N};{E};{P};{I}", '{{"name": "{N}", "email": "{E}", "phone": "{P}"}}', '{{"owner": "{N}", "address": "{A}", "id": "{I}"}}', 'login={E} street="{A}" nr={I}', "name={N} tel={P}", "From: {N} <{E}>", "To: {N} <{E}>", "--\n{N}\n{P}", "-- \n{N}\n{A}\n{P}\n{E}",
        "@maintainers ask {N} about it", "cc {N}, {N}", "The record of {N} carries the number {I}.", "a letter for {N}, {A}", "{N} has the number {I} and the phone {P}.", "talk to {N}", "signed {N}", "{N} said so", "mailed {E} yesterday, no answer", "the address {A} appears twice",
    ],
    "de": [
        "Ich habe mit {N} über den Haushalt gesprochen.", "Frau {N} ist nach {A} gezogen.", "Herr {N} leitet die Sitzung.", "Rufen Sie {N} nach sechs an: {P}.", "Das Paket ging an {A}, nicht an uns.", "Laut {N} kommt der Bericht später.", "Der Reisepass {I} läuft im Mai ab.",
        "Mit freundlichen Grüßen\n{N}", "Viele Grüße\n{N}\n{P}", "Sehr geehrte Frau {N},\nvielen Dank für den Brief.", "{N}, {A}", "{N} ({E})", "Die Nummer {I} steht auf dem Antrag von {N}.", "{N} arbeitet seit Juni hier.", "Danke, {N}!", "Bitte {N} anrufen, {P}.", "Bitte {N} Bescheid geben.", "mein Kollege {N}", "das Büro von {N}", "Der Vertrag mit {N} ist unterschrieben.", "schreib doch {E} an",
        "Dr. {N} ist im Urlaub.", "{N} und {N} kommen morgen.", "Wir wohnen jetzt {A}.", "Von: {N} <{E}>", "Leiten Sie das bitte an {N} weiter, {E} oder {P}.", "{N}\n{A}\n{P}", "Unter {P} meldet sich niemand.", "Die alte Karte {I} ist gesperrt.", "Schreiben Sie {E} oder rufen Sie {P} an.", "Per Mail an {E} oder telefonisch {P} melden.", "Frau {N} wohnt {A}.",
    ],
    "es": [
        "Ayer comí con {N} y hablamos del presupuesto.", "{N} se mudó a {A}.", "Puede llamar a {N} al {P}.", "El paquete llegó a {A} por error.", "Según {N}, el informe llega tarde.", "Su pasaporte {I} caduca en mayo.", "Un saludo,\n{N}", "Estimada {N}:\ngracias por la carta.", "{N}, {A}", "{N} ({E})",
        "El señor {N} firmó el contrato.", "Gracias, {N}.", "La doctora {N} está de vacaciones.", "De: {N} <{E}>", "Escriba a {E} o llame al {P}.", "{N} y {N} vienen mañana.", "vivimos en {A}", "el número {I} figura en la solicitud", "{N}\n{A}\n{P}", "Hable con {N} por {E} o por el {P}.", "{N}, que vive en {A}, no contesta.",
    ],
    "fr": [
        "Hier j'ai déjeuné avec {N}.", "{N} a déménagé au {A}.", "Vous pouvez joindre {N} au {P}.", "Le colis est arrivé au {A} par erreur.", "Selon {N}, le rapport est en retard.", "Son passeport {I} expire en mai.", "Cordialement,\n{N}", "Chère {N},\nmerci pour votre lettre.", "{N}, {A}", "{N} ({E})",
        "Monsieur {N} a signé le bail.", "Merci, {N}.", "Le docteur {N} est en vacances.", "De : {N} <{E}>", "Écrivez à {E} ou appelez le {P}.", "{N} et {N} viennent demain.", "nous habitons {A}", "le numéro {I} figure sur le dossier", "{N}\n{A}\n{P}", "Parlez à {N}, {E} ou {P}.", "{N}, qui habite {A}, ne répond pas.",
    ],
    "nl": [
        "Gisteren at ik met {N}.", "{N} is verhuisd naar {A}.", "U kunt {N} bellen op {P}.", "Het pakket kwam per ongeluk aan op {A}.", "Volgens {N} is het rapport te laat.", "Haar paspoort {I} verloopt in mei.", "Met vriendelijke groet,\n{N}", "Beste {N},\nbedankt voor de brief.", "{N}, {A}", "{N} ({E})",
        "De heer {N} tekende het contract.", "Bedankt, {N}.", "Dokter {N} is op vakantie.", "Van: {N} <{E}>", "Schrijf naar {E} of bel {P}.", "{N} en {N} komen morgen.", "wij wonen nu op {A}", "het nummer {I} staat op het formulier", "{N}\n{A}\n{P}", "Vraag het {N} via {E} of {P}.",
    ],
    "pt": [
        "Ontem almocei com {N}.", "{N} mudou-se para a {A}.", "Pode ligar a {N} para o {P}.", "A encomenda chegou à {A} por engano.", "Segundo {N}, o relatório está atrasado.", "O passaporte {I} caduca em maio.", "Cumprimentos,\n{N}", "Cara {N},\nobrigado pela carta.", "{N}, {A}", "{N} ({E})",
        "O senhor {N} assinou o contrato.", "Obrigada, {N}.", "A doutora {N} está de férias.", "De: {N} <{E}>", "Escreva para {E} ou ligue para {P}.", "{N} e {N} vêm amanhã.", "moramos na {A}", "o número {I} consta do pedido", "{N}\n{A}\n{P}", "Pergunte a {N} por {E} ou pelo {P}.",
    ],
    "ru": [
        "Вчера я обедал с {N}.", "{N} переехала: {A}.", "Позвоните {N} по номеру {P}.", "Посылка пришла по адресу {A}.", "По словам {N}, отчёт опаздывает.", "Паспорт {I} истекает в мае.", "С уважением,\n{N}", "Уважаемая {N}!\nспасибо за письмо.", "{N}, {A}", "{N} ({E})", "Договор подписал {N}.", "Спасибо, {N}!",
        "Доктор {N} в отпуске.", "От: {N} <{E}>", "Пишите на {E} или звоните {P}.", "{N} и {N} придут завтра.", "мы живём: {A}", "номер {I} указан в заявлении", "{N}\n{A}\n{P}", "Вопросы задавайте так: {N}, {E}, {P}.", "Заявку оставил {N}, номер {I}.",
    ],
    "zh": [
        "昨天我和{N}一起吃了午饭。", "{N}搬到了{A}。", "可以打{P}找{N}。", "包裹误送到{A}。", "据{N}说，报告会晚一点。", "{N}的护照{I}五月到期。", "此致\n{N}", "尊敬的{N}先生：\n谢谢来信。", "{N}，{A}", "{N}（{E}）", "合同由{N}签字。", "谢谢{N}！", "{N}医生正在休假。", "写信到{E}或拨打{P}。", "{N}和{N}明天来。",
        "我们住在{A}。", "表格上的号码是{I}。", "{N}\n{A}\n{P}", "{N}女士负责这个项目。", "请{N}老师审阅。", "{N}说会议推迟了。", "{N}的电话是{P}，邮箱是{E}。", "寄给{N}，地址{A}。", "今天{N}没有来上班。", "请联系{N}，电话{P}。", "请联系{N}，邮箱 {E}。", "有问题请联系{N}。", "收件人{N}，地址{A}。", "信封上写着收件人{N}。", "{N}的住址是{A}。", "{N}的新地址是{A}。", "{N}的办公室在{A}。", "{N}的生日在五月。", "{N}的孩子上学了。", "{N}的意见很有用。", "感谢{N}提供资料。", "感谢{N}提交材料。", "文件已交给{N}。", "寄到{A}，请{N}签收。", "这个问题是{N}发现的，{N}已经修好。", "感谢{N}的帮助。", "请找{N}，电话{P}。", "{N}的家在{A}。", "旧证件{I}已经作废。", "会议上{N}提出了新方案。", "{N}认为{N}写得很好。", "我同事{N}昨天去了北京。", "货物请寄到{A}，{N}收。", "号码 {I} 出现在列表里。", "手机：{P}", "地址：{A}",
    ],
}

#: Ordinary words; {n} of each language are mixed with made-up ones.
WORDS = {
    "en": "the a an of to in on for with and or but is are was were has have had will can may this that these every each some many few new old small large first last next open close read write load store send list count group table column value line page note file folder image sound water house garden road bridge market summer winter morning evening people child teacher student doctor engineer lesson story letter answer question number colour shape weight price after before while during because although however then therefore also often never always again into over under between without our your my his her its their we you they it he she not no only very more most such as by at from up out all both other",
    "de": "der die das ein eine einen einem einer und oder aber ist sind war waren hat haben wird werden kann dieser diese dieses jede jeder viele wenige neu alt klein groß erste letzte nächste öffnet schließt liest schreibt lädt speichert sendet zählt Haus Garten Straße Brücke Markt Sommer Winter Morgen Abend Wasser Bild Seite Zeile Tabelle Wert Datei Ordner Frage Antwort Brief Schule Lehrer Kind Preis Farbe Gewicht nach vor während weil obwohl jedoch dann daher auch oft nie immer wieder über unter zwischen ohne mit von zu im am beim zur zum nicht mehr alle keine unser unsere mein meine sein seine ihr ihre kein wir sie er es ich man sich dass wenn als wie so nur noch schon sehr",
    "es": "el la los las un una de del a al en con por para y o pero es son era fue ha tiene puede este esta cada muchos pocos nuevo viejo pequeño grande primero último abre cierra lee escribe carga guarda envía cuenta casa jardín puente mercado verano invierno mañana tarde agua imagen página línea tabla valor archivo pregunta respuesta carta escuela precio color peso después antes mientras porque aunque entonces también nunca siempre sobre entre sin nuestro nuestra su mi no más muy como todo otra",
    "fr": "le la les un une des de du à au en avec par pour et ou mais est sont était a ont peut ce cette chaque plusieurs peu nouveau vieux petit grand premier dernier ouvre ferme lit écrit charge garde envoie compte maison jardin pont marché été hiver matin soir eau image page ligne table valeur fichier question réponse lettre école prix couleur poids après avant pendant parce que bien alors aussi jamais toujours sur entre sans notre votre son sa mon ne pas plus très comme tout autre",
    "nl": "de het een van naar in op voor met en of maar is zijn was waren heeft hebben kan mag deze dit elke veel weinig nieuw oud klein groot eerste laatste opent sluit leest schrijft laadt bewaart stuurt telt huis tuin brug markt zomer winter ochtend avond water beeld bladzijde regel tabel waarde bestand vraag antwoord brief school prijs kleur gewicht na voor tijdens omdat hoewel dan ook nooit altijd over tussen zonder ons onze uw mijn zijn haar niet meer zeer als alle ander",
    "pt": "o a os as um uma de do da em no na com por para e ou mas é são era foi tem pode este esta cada muitos poucos novo velho pequeno grande primeiro último abre fecha lê escreve carrega guarda envia conta casa jardim ponte mercado verão inverno manhã tarde água imagem página linha tabela valor ficheiro pergunta resposta carta escola preço cor peso depois antes enquanto porque embora então também nunca sempre sobre entre sem nosso nossa seu sua não mais muito como todo outra",
    "ru": "и или но не в на с по для из от до у к о это этот эта каждый многие новый старый малый большой первый последний открывает закрывает читает пишет грузит хранит шлёт считает дом сад мост рынок лето зима утро вечер вода картина страница строка таблица значение файл вопрос ответ письмо школа цена цвет вес после перед пока потому хотя тогда также никогда всегда между без наш наша мой его её не уже ещё очень как все другой",
}
#: What joins a label and its value in a sentence.
COPULA = {"en": " is", "de": " lautet", "es": " es", "fr": " est", "nl": " is", "pt": " é", "ru": " —"}
OPENERS = {
    "en": "For example,|In general,|As a rule,|On the other hand,|In short,|By the way,",
    "de": "Zum Beispiel,|Zum Glück|Im Gegensatz dazu|In der Regel|Ohne Zweifel|Nach dem Essen,|Am Ende|Im Grunde|Zum Schluss,|Seit Montag|Auf Wunsch",
    "es": "Por ejemplo,|En general,|Sin embargo,|Al final,|Por suerte,",
    "fr": "Par exemple,|En général,|À la fin,|Par contre,|En fait,",
    "nl": "Bij voorbeeld,|In het algemeen,|Aan het eind,|Over het geheel|Ten slotte,",
    "pt": "Por exemplo,|Em geral,|No entanto,|No fim,|De resto,",
    "ru": "Например,|В целом,|В конце концов,|К счастью,|Кроме этого,",
}
CAPITALS = "Monday Tuesday Friday Sunday January March July October London Paris Berlin Madrid Lisbon Moscow Vienna Oslo England France Germany Europe Africa Amazon Google Linux Windows Python Excel English German French Internet Bible Christmas Easter"
#: Second words of titles and terms that are no names.
HEADS = "Server Service Manager Guide Protocol Filter Table Method Theorem Algorithm Tree Cache Index Search Path Model Network Engine Editor Driver Library Project Release Report Review Policy Plan Test Team Group Company University Institute Bank Hotel Airport Station Widgets Systems Industries Airlines Conference Award Museum River Island Mountain Merge Sort Graph Queue Pool Window Chapter Section Figure Standard Edition Mode Key Code Error Page Board Day Night Week"
FIRSTS = "Standard Quick Open Free Public Local Global Main Master Basic Binary Linear Random Neural Deep Smart Hard Soft High Low North South East West New Old Red Blue Green Black White Grand Royal National United Central General Common Active Remote Virtual Visual Total Final Style Load Write Read Query User Data Time Word Name Home Work Bloom Euler Turing Kalman Viterbi Poisson Gauss Fourier Newton Markov Bayes Fibonacci"

#: Plain Chinese, from which stretches are cut at the signs between clauses.
TEXT_ZH = (
    "今天的天气很好，我们打算去公园散步。这个城市的交通比以前方便多了，地铁每五分钟一班。图书馆里有很多新书，读者可以在网上预约。学校下周开始放假，学生们都很高兴。这台电脑运行得很慢，需要增加内存。请在安装之前备份所有文件，以免数据丢失。系统会自动保存设置，重新启动以后生效。如果出现错误，请查看日志并联系管理员。"
    "新的版本改进了搜索的速度，也修复了几个问题。程序先读取配置，再打开数据库的连接。每个字段都有自己的长度，空白的值会被忽略。缓存满了以后，最旧的记录首先被删除。查询的结果按照时间排列，用户可以选择不同的顺序。服务器在夜里进行维护，早上六点恢复正常。这篇文章介绍了如何建立索引，以及怎样合并分片。"
    "价格上涨的原因很多，其中最重要的是运输成本。市场上的水果又便宜又新鲜，大家都喜欢。他们讨论了一个小时，还是没有得出结论。公司决定推迟发布，因为测试还没有完成。文档的格式不对，编辑器拒绝打开它。磁盘空间不足的时候，写入操作会失败。为了提高效率，任务被分成许多小块，同时执行。这种方法在小机器上也能工作，只是慢一些。"
    "请注意，表格中的数字只是例子，不代表真实情况。多数语言都有自己的停用词，分词器需要词典。有时候同一个词在不同的文件里写法不同。比较两个版本以后，我们发现差别很小。升级的过程大约需要十分钟，期间不能使用。根据经验，第一次运行总是比较慢。此外，还要检查网络是否稳定。例如，电话号码和地址可以不填。然后点击确定，等待提示出现。不过，这个功能还在试验之中。"
    "联系方式请见网站首页，客服会尽快答复。收件人的栏目不能留空，否则无法发送。地址格式要统一，号码中间不加空格。姓名和证件信息属于隐私，必须加密保存。报告显示，系统的响应时间减少了一半。感谢大家的支持，欢迎提出宝贵意见。手机上也可以使用，界面会自动调整。邮箱已经验证，密码请定期更换。路口的红绿灯坏了，车辆排成长队。由于下雨，比赛改在明天。由于历史的原因，两个部门一直分开。由此可见，计划需要修改。高亮的文字更容易看到，高级选项默认关闭。高速公路今天免费，高峰时段请绕行。方便的话，请告诉我们。于是大家都同意了，对于这一点没有疑问。关于费用，另行通知。金额以账单为准，常见的错误列在下面。任何人都可以参加，任务已经完成。白天很热，夜晚凉快。万一停电，灯会自动亮。段落之间空一行，文件夹里有三张图片。时间不够，任意选择一项即可。程度不同，方法也不同。黄色表示警告，红色表示失败。第二天早上，雨停了，街上又热闹起来。"
)

NOUNS_ZH = "程序 模块 接口 线程 进程 队列 目录 窗口 按钮 菜单 算法 变量 函数 对象 表格 图片 视频 音乐 电影 文章 句子 词语 单词 段落 标题 字段 记录 索引 缓存 硬盘 内存 网页 浏览器 编译器 解释器 计算器 处理器 存储器 过滤器 监视器 备份 镜像 快照 日志 报表 任务 计划 步骤 阶段 版本 分支 补丁 工具 组件 服务 客户端 服务器 数据库 结果 错误 警告 消息 通知 请求 响应 规则 参数 选项 密码 账号 订单 商品 价格 仓库 车站 机场 医院 学校 教室 花园 河流 山脉 天气 季节 早晨 傍晚".split()
VERBS_ZH = "删除 更新 替换 加载 压缩 丢弃 锁定 移动 复制 粘贴 检查 比较 统计 收集 合并 拆分 排序 读取 写入 保存 发送 接收 打开 关闭 启动 停止 跳过 忽略 隐藏 显示 修改 增加 减少 返回 等待 推迟 取消 验证 分析 生成 导出 导入 上传 下载 重复 嵌套 覆盖 清空 限制 允许 拒绝 需要 使用 支持 影响 准备 完成 报告".split()
ADJECTIVES_ZH = "新的 旧的 空的 短小的 很长的 重要的 常见的 罕见的 隐藏的 全部 多余的 临时的 默认的 错误的 正确的 每个 这个 我们的 较小的 少量 大量 许多 第一个 最后一个".split()
ADVERBS_ZH = "很快 慢慢地 经常 偶尔 没有办法 在夜里 每天 每小时 突然 仍然 立即 同时 为了安全 因为下雨 由于故障 按照顺序 在大多数时候 从来不 已经 正在 再次 直到早上 毫无准备地 速度很快地 在高峰的时候 在空闲的时候 在高温下 慢得惊人 好得出奇 快到极点 经常性地 高度一致地 方便地 万一需要时 任何时候".split()

_ONSET = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fl fr gr kl kn pl pr qu sch sh sl sp st str th tr tw wh".split()
_VOWEL = "a e i o u a e i o ai au ea ee ei ie oo ou y".split()
_CODA = ["", "", "", "", *"l n r s t m d k x ck ld lt nd ng nk rd rk rn rt ss st".split()]
_ONSET_RU = "б в г д ж з к л м н п р с т ф х ч ш бр вл гр др кр пл пр св ст тр".split()
_VOWEL_RU = "а е и о у ы а е и о я".split()
TLDS = "com org net edu de fr es nl pt ru cn co.uk info io test example invalid"
TITLES = ["", "", "", "Mr. ", "Ms. ", "Dr. ", "Prof. "]


class Maker:
    """Seeded source of labelled documents: lists of ``(text, kind or None)`` pieces."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)
        self.clauses = [c for c in TEXT_ZH.replace("。", "，").split("，") if c]
        #: names and numbers of the document in hand, which later sentences may take up again
        self.known: list[str] = []
        self.numbers: list[tuple[str, str]] = []

    def word(self, low: int = 2, high: int = 4) -> str:
        r = self.r
        return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_CODA) for _ in range(r.randint(low, high) if r.random() < 0.6 else low))

    def word_ru(self) -> str:
        r = self.r
        return "".join(r.choice(_ONSET_RU) + r.choice(_VOWEL_RU) for _ in range(r.randint(2, 4)))

    def han(self, n: int) -> str:
        """Signs at random, mostly of the common set of 3,755, which its encoding keeps together."""
        r, out = self.r, ""
        while len(out) < n:
            if r.random() < 0.75:
                out += bytes((r.randint(0xB0, 0xD6), r.randint(0xA1, 0xFE))).decode("gb2312", "ignore")
            else:
                out += chr(r.randint(0x4E00, 0x9FA5))
        return out

    def hexes(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n - 1)) + self.r.choice("abcdef0123")

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "0" else c for c in pattern)

    def name(self, lang: str, again: float = 0.35) -> str:
        """A new name or, as likely as ``again``, one that the document has already."""
        r = self.r
        if self.known and r.random() < again:
            return self.variant(r.choice(self.known), lang)
        made = self.new_name(lang)
        if len(self.known) < 3:
            self.known.append(made)
        return made

    def variant(self, name: str, lang: str) -> str:
        """A known name again, as it was or turned round."""
        r, parts = self.r, name.split(" ")
        if len(parts) == 2 and "," not in name and "." not in name and r.random() < 0.3:
            return r.choice([f"{parts[1]}, {parts[0]}", f"{parts[0][0]}. {parts[1]}"])
        return name

    def new_name(self, lang: str) -> str:
        r = self.r
        if lang == "zh":
            # names are an open class: signs drawn at random teach the field to go by what stands around them
            x = r.random()
            family = r.choice(SURNAMES_ZH.split()) if x < 0.5 else r.choice(COMPOUND_ZH.split()) if x < 0.68 else self.han(1)
            return family + (r.choice(GIVEN_ZH.split()) if r.random() < 0.3 else self.han(1 if r.random() < 0.15 else 2))
        if lang == "ru":
            stem = r.choice(STEMS_RU.split()) if r.random() < 0.4 else self.word_ru().capitalize()
            first, last = r.choice(GIVEN["ru"].split()) if r.random() < 0.6 else self.word_ru().capitalize(), stem + r.choice(ENDINGS_RU.split())
        else:
            first = r.choice(GIVEN[lang].split()) if r.random() < 0.5 else self.word(1, 3).capitalize()
            last = r.choice(FAMILY[lang].split()) if r.random() < 0.3 else self.word(2, 4).capitalize()
            if r.random() < 0.1:
                first = r.choice("ÁÉÍÓÚÄÖÜČŠŽŁ") + first[1:]
            if r.random() < 0.12 and len(last) > 4:
                i = r.randint(1, len(last) - 2)
                last = last[:i] + r.choice("áéíóúäöüñçãèêëïðøåšžł") + last[i + 1 :]
            if r.random() < 0.05:
                last = r.choice("ČĐŁŚŞŠŽİŐ") + last[1:]
            x = r.random()
            if lang in PARTICLES and r.random() < 0.1:
                last = r.choice(PARTICLES[lang].split("|")) + " " + last
            elif x < 0.08:
                last = r.choice(["O'", "Mc", "d'", "D’", "Mac"]) + last
            elif x < 0.17:
                last += "-" + self.word().capitalize()
            if r.random() < 0.06:
                first += "-" + self.word(1, 2).capitalize()
        if r.random() < 0.16:
            first = first[0] + "."
        elif r.random() < 0.13:
            first += f" {r.choice('ABCDEGHKLMNRST')}."
        if r.random() < 0.12:
            last = last.upper()
        return f"{last}, {first}" if r.random() < 0.22 else f"{first}{'  ' if r.random() < 0.03 else ' '}{last}"

    def email(self, lang: str) -> str:
        r = self.r
        a, b, n = self.word(1, 2), self.word(1, 3), r.randint(1, 2999)
        local = r.choice([f"{a}.{b}", f"{a}{n}", f"{b}_{n}", f"{a}+{b}", f"{b}-{a}", f"{a}.{b}.{n}", a, f"{a[0]}{b}", f"{a.capitalize()}.{b.capitalize()}"])
        domain = (self.word(1, 3) + "." if r.random() < 0.3 else "") + self.word(1, 3) + "." + r.choice(TLDS.split())
        if r.random() < 0.25:
            at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", "."), ("＠", "."), (" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", " {dot} "), ("&#64;", ".")])
            return local + at + domain.replace(".", dot)
        s = f"{local}@{domain}"
        return s.upper() if r.random() < 0.08 else s

    def phone(self, lang: str) -> str:
        """Country formats in general use; an empty country prefix is as likely as one."""
        r = self.r
        if lang == "en":
            a, b, c = "000", "000", "0000"
            s = self.digits(r.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"({a}) {b}-{c}", f"+1{a}{b}{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+1 {a} {b} {c}", "020 0000 0000", "+44 20 0000 0000", "07000 000000", "+44 7000 000000", "+91 00000 00000"]))
        elif lang == "zh":
            s = self.digits(r.choice(["1" + "0" * 10, "+86 100 0000 0000", "+8610000000000", "010-00000000", "(021) 0000 0000", "0755-0000000", "021 00000000", "100-0000-0000"]))
        elif lang == "ru":
            s = self.digits(r.choice(["+7 (000) 000-00-00", "8 800 000 00 00", "+7 000 000-0000", "8 (000) 000-00-00", "+70000000000", "8-000-000-00-00"]))
        else:
            code = {"de": "49", "es": "34", "fr": "33", "nl": "31", "pt": r.choice(["351", "55"])}[lang]
            body = self.digits(r.choice({"de": ["00 0000000", "000 0000000", "0000 000000", "00 00000-00", "00-0000-000", "(0000) 0000 000", "000/00000000", "00-00000-000"], "es": ["000 000 000", "00 000 00 00", "000-000-000", "000 00 00 00", "000000000"], "fr": ["0 00 00 00 00", "00 00 00 00 00", "00.00.00.00.00", "0000000000"], "nl": ["00 0000 0000", "000-0000000", "06-00000000", "6 00000000", "20 000 00 00"], "pt": ["00 00000-0000", "000 000 000", "(00) 00000-0000", "00 0000-0000", "210 000 000"]}[lang]))
            x = r.random()
            if x < 0.35:
                s = f"+{code} {body.lstrip('(').replace(')', '') if r.random() < 0.5 else body}"
            elif x < 0.46:
                s = f"00{code}{r.choice(' -')}{body.lstrip('(').replace(')', '')}"
            elif x < 0.52:
                s = f"+{code}(0){body.lstrip('(0').replace(')', '')}"
            else:
                s = body if body[0] in "(0" or lang in ("es", "pt") else "0" + body
        return s.replace(" ", " ") if r.random() < 0.07 else s

    def identity(self, lang: str) -> str:
        """Layouts of public identity, tax and passport numbers; A stands for a letter."""
        forms = {
            "en": "A00000000|AA000000A|AA 00 00 00 A|000-00-0000|000 00 0000|000000000|A0000000",
            "de": "A00000000|00 000 000 000|A00A00A00|00000000000|000/000/00000|00 000000 A 000|AA0000000",
            "es": "00000000A|00.000.000-A|A0000000A|AAA000000|00000000-A",
            "fr": "0 00 00 00 000 000 00|0 00 00 00 000 000|000000000000000|00AA00000|0000000000000",
            "nl": "000000000|0000.00.000|AA0000000|0000 00 000",
            "pt": "000.000.000-00|00000000000|000 000 000|00.000.000-0|AA000000",
            "ru": "000-000-000 00|00 00 000000|0000 000000|000000000000",
            "zh": "0" * 18 + "|" + "0" * 17 + "X|A00000000|E00000000",
        }[lang].split("|")
        s = self.digits(self.r.choice(forms))
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") if c == "A" else c for c in s)

    def address(self, lang: str) -> str:
        r = self.r
        n = str(r.randint(1, 299) if r.random() < 0.9 else r.randint(1000, 99999)) + (r.choice("abcdABC") if r.random() < 0.15 else "")
        w = self.word(2, 4).capitalize() if r.random() < 0.85 else r.choice(FIRSTS.split())
        if lang == "en":
            kind = r.choice("Street St. Road Rd Rd. Lane Avenue Ave Blvd. Boulevard Drive Close Court Square Way Terrace".split())
            return f"{n} {r.choice(['', '', '', 'North ', 'Old ', 'East ', 'Upper ', 'West '])}{w} {kind}"
        if lang == "de":
            return r.choice(["{w}straße", "{w}str.", "{w}weg", "Am {w}platz", "{w}gasse", "{w}allee", "{w}platz", "Alte {w}straße", "An der {w}mühle", "{w}damm", "{w}-Straße", "Straße des {w}"]).format(w=w) + f" {n}"
        if lang == "es":
            return r.choice(["Avenida de {w}", "Avenida {w}", "C/ {w}", "Calle {w}", "Calle de {w}", "Plaza {w}", "Plaza de {w}", "Av. {w}", "Paseo de {w}", "Camino de {w}"]).format(w=w) + r.choice([", ", " ", ", nº ", ", n.º "]) + n
        if lang == "fr":
            b = r.choice([" bis", " ter", "", "", "", ""])
            return f"{n}{b}" + r.choice([", ", " "]) + r.choice(["avenue de {w}", "boulevard {w}", "rue {w}", "impasse du {w}", "rue de {w}", "rue de la {w}", "chemin du {w}", "av. {w}", "bd {w}", "place {w}", "quai {w}", "allée des {w}", "rue des {w}s", "rue du {w}"]).format(w=w)
        if lang == "nl":
            return f"{w}" + r.choice(["straat", "laan", "gracht", "weg", "plein", "kade", "dijk", "singel", "steeg"]) + f" {n}"
        if lang == "pt":
            return r.choice(["Rua {w}", "Travessa de {w}", "Travessa do {w}", "Rua do {w}", "Rua da {w}", "Rua das {w}s", "Rua dos {w}s", "Avenida {w}", "Av. {w}", "Largo da {w}", "Praça {w}", "Alameda {w}", "Estrada de {w}"]).format(w=w) + r.choice([", ", " ", ", nº ", ", n.º "]) + n
        if lang == "ru":
            s = r.choice(STREETS_RU.split()) if r.random() < 0.6 else self.word_ru().capitalize() + r.choice(["ая", "ская", "ого", "ова"])
            return r.choice(["ул. {s}, д. {n}", "улица {s}, {n}", "ул. {s}, {n}", "{s} ул., {n}", "проспект {s}, {n}", "пр. {s}, д. {n}", "пер. {s}, д. {n}", "ул. {s}, дом {n}", "{s} улица, д. {n}"]).format(s=s, n=n)
        return (r.choice(STREETS_ZH.split()) if r.random() < 0.4 else self.han(2)) + r.choice(["路", "东路", "南路", "北路", "大街", "大道", "巷", "街", "西路", "胡同"]) + str(r.randint(1, 999)) + "号"

    # ------------------------------------------------------------------ decoys

    def number(self) -> str:
        """A number that tells nothing about a person, with what is usual before it."""
        r = self.r
        d = lambda k: self.digits("0" * k)
        n = r.randint(1, 999)
        return r.choice(
            [
                lambda: f"order {d(8)}", lambda: f"ticket {d(r.randint(3, 8))}", lambda: f"invoice {d(7)}", lambda: f"(build {d(8)}.{n})", lambda: f"build {d(8)}", lambda: f"({d(r.randint(2, 9))})", lambda: f"rev {d(5)}", lambda: f"doc-{d(r.randint(3, 8))}", lambda: f"({r.choice(['doc', 'ref', 'job', 'run'])}-{d(r.randint(3, 8))})", lambda: f"part_{n}", lambda: f"({self.word(1, 1)}_{n})", lambda: f"v{n % 20}.{n % 17}.{n % 13}", lambda: f"({self.word(1, 1)}@v{n % 9}.{n % 7})", lambda: f"{r.choice('ABCJKR')}{r.choice('EOIU')}{r.choice('RSTX')}-{d(r.randint(3, 5))}", lambda: f"({r.choice('ABCJKR')}{r.choice('EOIU')}{r.choice('RSTX')}-{d(r.randint(3, 5))})", lambda: f"[{d(r.randint(2, 6))}]", lambda: f"{n}.{d(2)}", lambda: f"({n}.{d(2)})", lambda: f"{n}.{d(3)} ms", lambda: f"{n},{d(3)}", lambda: f"{n} %", lambda: f"port {d(4)}", lambda: f"10.{n % 256}.{n % 99}.{n % 7}", lambda: f"({n % 256}.0.2.{n % 99}:{d(4)})", lambda: f"192.168.{n % 9}.{n % 256}", lambda: f"20{d(2)}-0{n % 9 + 1}-1{n % 9}", lambda: f"(20{d(2)}-0{n % 9 + 1}-1{n % 9}T1{n % 9}:2{n % 9}:3{n % 9}Z)", lambda: f"1{n % 9}:2{n % 9}:0{n % 9}", lambda: f"{d(7)} bytes", lambda: f"({r.choice(['read', 'wrote', 'sent', 'got'])} {d(r.randint(5, 9))} bytes)", lambda: f"sha {''.join(r.choice('0123456789abcdef') for _ in range(r.choice([8, 16])))}", lambda: f"https://{self.word()}.example/{d(5)}", lambda: f"({n % 50}-{n % 50 + 3}-{n % 50 + 9}-{d(2)})", lambda: f"(lines {n % 50}-{n % 50 + 2}-{n % 50 + 9}-{n})", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)} items of {d(8)}", lambda: f"{n} rows", lambda: f"page {n}", lambda: f"No. {n}", lambda: f"x{n}", lambda: f"{n}", lambda: f"{n} of {n + 9}", lambda: f"${n}.{d(2)}", lambda: f"{n} EUR", lambda: f"{self.word(1, 2)}:{self.word(1, 1)}@{n % 9}", lambda: f"({self.word(1, 2)}:{self.word(1, 1)}@{n % 9})", lambda: f"{d(10)} ns", lambda: f"0x{d(6)}", lambda: self.hexes(8), lambda: f"({self.hexes(8)})", lambda: d(7) + r.choice('abcdef'), lambda: d(r.randint(5, 14)) + r.choice('abcdef'), lambda: self.hexes(r.choice([7, 12, 16])),
            ]
        )()

    def title(self) -> str:
        """Capitalised words that are no name."""
        r = self.r
        head = r.choice(HEADS.split())
        first = r.choice(FIRSTS.split()) if r.random() < 0.6 else self.word(1, 3).capitalize()
        n = r.randint(1, 99)
        return r.choice([f"{first} {head}", f"the {first} {head}", f"({first} {head})", f"(the {first} {head})", f"{first} {r.choice(HEADS.split())} {head}", f"(a {n} {first} {head})", f"{head} {n}", f"({head} {n}, {r.choice(HEADS.split())} {n + 1})", r.choice(CAPITALS.split()), f"{r.choice(CAPITALS.split())} {head}", f"{first} and {head}", f"{head} of {first}", f"# {first} {head}", f"{first}, {r.choice(CAPITALS.split())}", f"{first.upper()}"])

    def plain(self, lang: str) -> str:
        """A sentence without personal data: known and made-up words, with numbers and titles among them."""
        r = self.r
        if lang == "zh":
            out = ""
            for _ in range(r.randint(1, 4)):
                if r.random() < 0.4:
                    a, b, c = r.choice(NOUNS_ZH), r.choice(NOUNS_ZH), r.choice(NOUNS_ZH)
                    subject = r.choice([a, a, r.choice(ADJECTIVES_ZH) + a, f"{a}和{b}都", f"{a}{b}"])
                    out += subject + (r.choice(ADVERBS_ZH) if r.random() < 0.5 else "") + r.choice(VERBS_ZH) + r.choice(["", "", "了"]) + (r.choice(ADJECTIVES_ZH) if r.random() < 0.5 else "") + c
                else:
                    out += r.choice(self.clauses) if r.random() < 0.5 else "".join(x[(i := r.randint(0, max(0, len(x) - 3))) : i + r.randint(2, 6)] for x in r.sample(self.clauses, 2))
                if r.random() < 0.2:
                    out += r.choice([" ", ""]) + self.word() + r.choice([" ", ""])
                if r.random() < 0.05:
                    out += self.han(r.randint(1, 4))
                if r.random() < 0.12:
                    out += r.choice(["（", "("]) + self.number() + r.choice(["）", ")"])
                out += r.choice("，，，、；")
            return out[:-1] + r.choice("。。。！？")
        if lang == "de" and r.random() < 0.4:
            # articles and nouns, which German writes with capitals
            noun = self.word(1, 3).capitalize() + r.choice(["", "", "er", "ung", "keit", "en", "t"])
            out = [r.choice("Der Die Das Ein Eine Unser Unsere Jede Jeder Dieser Diese Kein Mein Alle Im Am Vom Zur".split()), noun]
            if r.random() < 0.3:
                out.insert(1, self.word(1, 3) + r.choice(["e", "er", "en"]))
        elif r.random() < 0.1:
            out = [r.choice(OPENERS[lang].split("|"))]
        else:
            out = []
        known = WORDS[lang].split()
        for i in range(r.randint(3, 14)):
            x = r.random()
            if x < 0.62:
                w = r.choice(known)
            elif lang == "ru" and x < 0.8:
                w = self.word_ru() + r.choice(["", "ть", "ет", "ый", "ая", "ов", "ом"])
            elif x < 0.88:
                w = self.word(1, 4)
                if lang == "de" and r.random() < 0.5:
                    w = w.capitalize() + r.choice(["", "ung", "heit", "er", "en"])
                if r.random() < 0.1:
                    w += "-" + self.word(2, 3).capitalize()
            elif x < 0.94:
                w = self.number()
            else:
                w = self.title() if lang != "ru" or r.random() < 0.3 else self.word_ru().capitalize()
            if r.random() < 0.04:
                w += "-" + self.word(1, 2)
            if r.random() < 0.03:
                w = f"{w.capitalize()} {r.randint(1, 99)}"
            out.append((w[:1].upper() + w[1:] if i == 0 and r.random() < 0.8 else w) + (r.choice([",", ",", ";", ":"]) if r.random() < 0.09 else ""))
        return " ".join(out) + r.choice([".", ".", ".", "", "!", "?", f" ({self.number()})", f" {self.word()}/{self.word()}."])

    # --------------------------------------------------------------- documents

    def piece(self, key: str, lang: str) -> tuple[str, str]:
        """A value and its kind; a number of the document may come again in another spelling."""
        r = self.r
        if key in "PI" and (again := [(n, k) for n, k in self.numbers if k == key]) and r.random() < 0.25:
            n = r.choice(again)[0]
            return r.choice([n, n, n.replace("-", " ")]), {"P": "phone", "I": "id_number"}[key]
        made, kind = self.new_piece(key, lang)
        if key in "PI" and len(self.numbers) < 3:
            self.numbers.append((made, key))
        return made, kind

    def new_piece(self, key: str, lang: str) -> tuple[str, str]:
        made = {"N": self.name, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address}[key](lang)
        return made, {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}[key]

    def labelled(self, lang: str) -> list[tuple[str, str | None]]:
        """One to four fields: a label, a sign, the value, now and then something after it."""
        r = self.r
        sep = r.choice([": ", ": ", ":", " ", " ", " - ", "=", " : "]) if lang != "zh" else r.choice(["：", "：", ": ", "", " ", "是"])
        end = r.choice(["\n", "\n", ", ", "; ", " | ", " "]) if lang != "zh" else r.choice(["\n", "，", "；", "。", " "])
        out: list[tuple[str, str | None]] = []
        for key in r.sample("NNPPIIAAE", r.randint(1, 4)):
            label = r.choice(LABELS[lang][key].split("|"))
            if sep == " " and key != "E" and r.random() < 0.3:
                label += COPULA.get(lang, "")
            label = label.lower() if lang != "zh" and r.random() < 0.2 else label
            out.append((label + sep, None))
            quote = '"' if sep == "=" and key != "E" and r.random() < 0.5 else ""
            mark = r.random() < 0.1 and lang != "zh"
            title = r.choice(TITLES) if key == "N" and lang == "en" else ""
            out += [(quote + title, None)] * bool(quote + title) + [self.piece(key, lang)] + [(quote, None)] * bool(quote)
            if key == "N" and r.random() < 0.2:
                a, b = (" <", ">") if r.random() < 0.6 else (" (", ")") if lang != "zh" else ("（", "）")
                out += [(a, None), self.piece("E", lang), (b, None)]
            out.append((r.choice(". ! ) ,".split()) + " " if mark else end, None))
        return out

    def fill(self, template: str, lang: str) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        rest = template.replace("{{", "\x01").replace("}}", "\x02")
        while rest:
            i = rest.find("{")
            out.append((rest if i < 0 else rest[:i], None))
            if i < 0:
                break
            out.append(self.piece(rest[i + 1], lang))
            rest = rest[i + 3 :]
        return [(t.replace("\x01", "{").replace("\x02", "}"), k) for t, k in out if t]

    def around(self, lang: str) -> list[tuple[str, str | None]]:
        """A name, or sometimes another piece, amid made-up words, where little but its form speaks for it."""
        r = self.r
        if lang == "zh":
            before = r.choice(["", r.choice(self.clauses) + "，", r.choice(self.clauses) + "。"]) + r.choice(["", "", "", *"请 由 和 找 给 请教 感谢 通知 见到 问 听 同事 经理 学生 跟 对 让 在 被 向 从 是 为".split()])
            after = r.choice(["", "", *"说 在 和 的 去 把 已经 将 ， 。 （ 也 都 还 就 要 想 会 是 有 没 被 让 帮 跟 对 从 向 到 做 写 看 那里 这里 上周 昨天 最近 正在 回来".split()])
            return [(before, None), (self.name(lang, 0.6), "name"), (after + r.choice(self.clauses), None)]
        w = self.word if lang != "ru" else self.word_ru
        some = lambda low, high: " ".join(r.choice(WORDS[lang].split()) if r.random() < 0.6 else w() for _ in range(r.randint(low, high)))
        before = some(1, 1 if r.random() < 0.3 else 4)
        key = r.choice("NNNNNNNAAPI")
        piece = (self.name(lang, 0.6), "name") if key == "N" else self.piece(key, lang)
        return [((before.capitalize() if r.random() < 0.45 else before) + r.choice([" ", " ", " ", "; ", ", "]), None), piece, (r.choice([" ", " ", ", ", ". ", " ("]) + some(1, 4), None)]

    def document(self) -> list[tuple[str, str | None]]:
        """Two to seven sentences, somewhat fewer than half of which tell personal data."""
        r = self.r
        lang = r.choice([*PROSE, "zh", "zh", "de", "en"])
        out: list[tuple[str, str | None]] = []
        self.known, self.numbers = [], []
        for _ in range(r.randint(2, 7)):
            x, tongue = r.random(), lang if r.random() < 0.85 else r.choice(list(PROSE))
            if x < 0.24:
                out += self.fill(r.choice(PROSE[tongue]), tongue)
            elif x < 0.37:
                out += self.labelled(tongue)
            elif x < 0.45:
                out += self.around(tongue)
            else:
                out.append((self.plain(lang if r.random() < 0.7 else "en"), None))
            out.append((r.choice([" ", "  ", "\n", "\n\n", " ", ". ", "? ", "! "]) if lang != "zh" or r.random() < 0.5 else "", None))
        return out


def make(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` documents as text and spans ``(start, end, kind)``."""
    m, out = Maker(seed), []
    for _ in range(n):
        text, spans = "", []
        for piece, kind in m.document():
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece
        out.append((text, spans))
    return out
