"""Pages written by hand in the manner of site software, none from the generator: (html, main text).

Names are foreign or say nothing; forms wrap pages; articles hold link lists; readers comment in lists and divs."""

LAYOUTS = [
    ("""<html lang=de><body><div id="kopf"><a href="/">Startseite</a> <a href="/a">Sport</a> <a href="/b">Wetter</a></div><div id="inhalt"><h1>Der Fluss steigt weiter</h1><p>Am Montag stand das Wasser fünf Meter hoch. Die Brücke bleibt gesperrt.</p><p>Die Stadt rechnet erst am Freitag mit Entspannung.</p></div><div id='kommentare'><h3>Kommentare</h3><div class="k"><div>Peter, 12 Uhr</div><p>Das habe ich schon lange gesagt. Niemand hört zu.</p></div><div class="k"><div>Anna, 13 Uhr</div><p>Wir haben den Keller ausgepumpt.</p></div></div><div id="fuss">Impressum und Datenschutz</div></body></html>""", "Der Fluss steigt weiter Am Montag stand das Wasser fünf Meter hoch. Die Brücke bleibt gesperrt. Die Stadt rechnet erst am Freitag mit Entspannung."),
    ("""<html><body><article><h1>Two papers on tides</h1><p>Two papers changed how we see tides this year.</p><ul><li><a href="/p1">Tides of the northern bays</a></li><li><a href="/p2">A model of slack water</a></li></ul><p>Both of them are free to read.</p></article><div class='outbrain'><h4>You may like</h4><p>One weird trick to dry your socks.</p><p>Ten boats that nobody wants to buy.</p></div></body></html>""", "Two papers on tides Two papers changed how we see tides this year. Tides of the northern bays A model of slack water Both of them are free to read."),
    ("""<html><body><form method=post action="p.aspx"><input type=hidden name=state value=x><div><ul><li><a href=1>Home</a></li><li><a href=2>Products</a></li><li><a href=3>Contact</a></li></ul></div><div><h1>Annual report of the mill</h1><p>The mill ground forty tons of wheat, more than in any year before.</p><p>Two new stones were laid in May.</p></div></form></body></html>""", "Annual report of the mill The mill ground forty tons of wheat, more than in any year before. Two new stones were laid in May."),
    ("""<html lang=fr><body><header><a href="/">Le Journal</a></header><nav><ul><li><a href=/m>Monde</a></li><li><a href=/s>Sciences</a></li></ul></nav><main><h1>Une comète visible ce soir</h1><p>La comète passera au plus près de la Terre vers minuit. Il suffira de lever les yeux.</p><blockquote>Je n'ai jamais rien vu de pareil.</blockquote><p>Elle ne reviendra que dans huit mille ans.</p></main><section class="commentaires"><h2>3 réactions</h2><ul><li><div>Luc</div><p>Superbe, merci pour cet article.</p></li><li><div>Zoé</div><p>Il y a trop de nuages ici.</p></li></ul></section><footer>Mentions légales</footer></body></html>""", "Une comète visible ce soir La comète passera au plus près de la Terre vers minuit. Il suffira de lever les yeux. Je n'ai jamais rien vu de pareil. Elle ne reviendra que dans huit mille ans."),
    ("""<html lang=es><body><div class="cabecera"><ul><li><a href=/>Inicio</a><li><a href=/n>Noticias</a><li><a href=/d>Deportes</a></ul></div><div class="q1"><h1>Vuelve el tren del sur</h1><p>El primer tren salió a las seis de la mañana. Llevaba a doscientos viajeros.</p><h2>Los horarios</h2><table><tr><th>Salida</th><th>Llegada</th></tr><tr><td>6:00</td><td>9:30</td></tr></table><p>Habrá dos trenes al día hasta marzo.</p></div><div class="publicidad"><p>Compre ahora su billete.</p></div><div class="pie">Todos los derechos reservados.</div></body></html>""", "Vuelve el tren del sur El primer tren salió a las seis de la mañana. Llevaba a doscientos viajeros. Los horarios Salida Llegada 6:00 9:30 Habrá dos trenes al día hasta marzo."),
    ("""<html><body><div><div><a href=/>A</a> | <a href=/b>B</a> | <a href=/c>C</a> | <a href=/d>D</a></div><div><h1>How to sharpen a scythe</h1><p>Lay the blade on an anvil and tap the edge thin.</p><p>Then take a wet stone, and draw it from the heel to the tip.</p><ol><li>Never cut towards your leg.</li><li>Sharpen every quarter of an hour.</li></ol></div><div><ul><li><a href=/1>How to mow</a></li><li><a href=/2>How to rake</a></li><li><a href=/3>How to stack</a></li><li><a href=/4>How to dry</a></li></ul></div></div></body></html>""", "How to sharpen a scythe Lay the blade on an anvil and tap the edge thin. Then take a wet stone, and draw it from the heel to the tip. Never cut towards your leg. Sharpen every quarter of an hour."),
    ("""<html><body><div class="x1"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div><div class="x2"><h1>The last lighthouse keeper</h1><p>She climbed the stairs four times a night for thirty years.</p><p>Now a lamp turns by itself, and the door is locked.</p></div><div class="x3"><div class="x4"><div><a href=/u1>mara</a> 3 days ago</div><p>My aunt lived there too. She told us the same.</p><div><a href=/r>Reply</a></div></div><div class="x4"><div><a href=/u2>jon</a> 2 days ago</div><p>What a story!</p><div><a href=/r>Reply</a></div></div><div class="x4"><div><a href=/u3>kim</a> 1 day ago</div><p>I would like to visit it in the summer, if it is open.</p><div><a href=/r>Reply</a></div></div></div></body></html>""", "The last lighthouse keeper She climbed the stairs four times a night for thirty years. Now a lamp turns by itself, and the door is locked."),
    ("""<html lang=it><body><div class="menu"><a href=/>Home</a><a href=/c>Cronaca</a></div><article><h1>Il ponte riapre</h1><p>Dopo due anni di lavori il ponte è di nuovo aperto alle auto.</p><aside class="correlati"><h4>Leggi anche</h4><ul><li><a href=/1>Il traffico in centro</a></li><li><a href=/2>I nuovi autobus</a></li><li><a href=/3>La pista ciclabile</a></li></ul></aside><p>I lavori sono costati nove milioni.</p></article><div class="commenti"><p>Era ora, finalmente si passa.</p></div></body></html>""", "Il ponte riapre Dopo due anni di lavori il ponte è di nuovo aperto alle auto. I lavori sono costati nove milioni."),
    ("""<html lang=ru><body><div class="shapka"><a href=/>Главная</a> <a href=/n>Новости</a> <a href=/k>Контакты</a></div><div class="tekst"><h1>Зима пришла рано</h1><p>Первый снег выпал в сентябре. Такого не было сорок лет.</p><p>Дороги чистят днём и ночью.</p></div><div class="podval">Все права защищены</div></body></html>""", "Зима пришла рано Первый снег выпал в сентябре. Такого не было сорок лет. Дороги чистят днём и ночью."),
    ("""<html lang=ja><body><nav><ul><li><a href=/>ホーム</a></li><li><a href=/n>ニュース</a></li></ul></nav><main><h1>桜が咲いた</h1><p>今年の桜は例年より一週間早く咲きました。</p><p>公園には多くの人が集まりました。</p></main><footer>著作権所有</footer></body></html>""", "桜が咲いた 今年の桜は例年より一週間早く咲きました。 公園には多くの人が集まりました。"),
    ("""<html><body><table width="100%"><tr><td width=150><a href=1>Index</a><br><a href=2>Photos</a><br><a href=3>Guestbook</a><br><a href=4>Links</a></td><td><h1>My trip to the glacier</h1><p>We started before sunrise, with ropes and four days of food.</p><p>On the second day the fog came down, and we waited in the tent.</p></td></tr></table></body></html>""", "My trip to the glacier We started before sunrise, with ropes and four days of food. On the second day the fog came down, and we waited in the tent."),
    ("""<html><body><div class="gdpr"><p>We and our partners use cookies.</p><button>OK</button></div><header><h1><a href=/>Daily Planet</a></h1></header><article><h2>Council votes for trees</h2><p>The council voted to plant a thousand trees along the main road.</p><p>The first will be planted in autumn, said the mayor.</p></article><footer><p>Terms of use</p></footer></body></html>""", "Council votes for trees The council voted to plant a thousand trees along the main road. The first will be planted in autumn, said the mayor."),
    ("""<html lang=nl><body><div id="menu"><ul><li><a href=/>Thuis</a><li><a href=/w>Weer</a></ul></div><section id="verhaal"><h1>De dijk houdt stand</h1><p>De nieuwe dijk heeft zijn eerste storm doorstaan. Er was geen schade.</p><p>Volgend jaar wordt hij nog een meter hoger.</p></section><div id="reacties"><h3>Reacties</h3><ul><li><b>Jan</b><p>Mooi werk van de ploeg.</p></li><li><b>Els</b><p>Het heeft wel lang geduurd.</p></li></ul></div></body></html>""", "De dijk houdt stand De nieuwe dijk heeft zijn eerste storm doorstaan. Er was geen schade. Volgend jaar wordt hij nog een meter hoger."),
    ("""<html><body><main><h1>Release notes</h1><h2>Fixed</h2><ul><li>The clock no longer stops at midnight.</li><li>Names may hold spaces.</li></ul><h2>Added</h2><ul><li>A dark theme.</li></ul><p>See <a href=/all>all changes</a> since the last year.</p></main><form action=/login><p>Please log in to vote.</p><input name=u></form></body></html>""", "Release notes Fixed The clock no longer stops at midnight. Names may hold spaces. Added A dark theme. See all changes since the last year."),
    ("""<html><body><p>Just a note that was put online without any layout. It has two sentences.</p><p>And one more paragraph, which ends here.</p></body></html>""", "Just a note that was put online without any layout. It has two sentences. And one more paragraph, which ends here."),
]

#: Written after the model's features and layouts were settled; nothing was changed for them.
HELD_OUT = [
    ("""<html lang=pl><body><div class="naglowek"><a href=/>Gazeta</a><ul><li><a href=/k>Kraj</a><li><a href=/s>Sport</a><li><a href=/m>Moto</a></ul></div><div class="tresc"><h1>Nowy most otwarty</h1><p>Most przez rzekę otwarto w sobotę. Przyszły tłumy mieszkańców.</p><h3>Ile kosztował</h3><p>Budowa kosztowała sześćdziesiąt milionów.</p></div><div class="komentarze"><div class="kom"><span>Ola</span><p>Nareszcie, czekaliśmy dziesięć lat.</p></div><div class="kom"><span>Jan</span><p>Szkoda, że bez ścieżki rowerowej.</p></div></div><div class="stopka">Wszelkie prawa zastrzeżone</div></body></html>""", "Nowy most otwarty Most przez rzekę otwarto w sobotę. Przyszły tłumy mieszkańców. Ile kosztował Budowa kosztowała sześćdziesiąt milionów."),
    ("""<html><body><form id=aspnetForm action=x><div id=top><a href=/>Home</a> <a href=/about>About us</a> <a href=/jobs>Jobs</a></div><article><h1>Harvest figures for the valley</h1><p>The valley brought in nine thousand tons of apples this year.</p><p>Pears did badly because of the late frost in April.</p><ul><li>Apples: 9,000 tons.</li><li>Pears: 400 tons.</li></ul></article><div id=bottom>Ministry of fields, 1 Market square</div></form></body></html>""", "Harvest figures for the valley The valley brought in nine thousand tons of apples this year. Pears did badly because of the late frost in April. Apples: 9,000 tons. Pears: 400 tons."),
    ("""<html lang=pt><body><nav><ul><li><a href=/>Início</a></li><li><a href=/e>Economia</a></li></ul></nav><article><h1>A feira voltou ao largo</h1><p>Depois de três anos, a feira voltou ao largo da igreja.</p><figure><img src=a><figcaption>A praça no sábado de manhã.</figcaption></figure><p>Os vendedores chegaram antes das cinco.</p></article><aside><h4>Mais lidas</h4><ol><li><a href=/1>O preço do pão</a></li><li><a href=/2>A ponte nova</a></li><li><a href=/3>Chuva no norte</a></li></ol></aside><footer>Sobre nós</footer></body></html>""", "A feira voltou ao largo Depois de três anos, a feira voltou ao largo da igreja. A praça no sábado de manhã. Os vendedores chegaram antes das cinco."),
    ("""<html><body><div class="h"><div class="l"><a href=/>bluepage</a></div></div><div class="m"><div class="t"><h1>Why the bees came back</h1></div><div class="b"><p>Ten years ago there was not a single hive in the valley.</p><p>Farmers stopped spraying, and the lime trees along the road grew old enough to bloom.</p><p>Now there are four hundred hives.</p></div></div><ol><li><div><a href=/u>ana</a></div><p>We put up two hives ourselves last May.</p></li><li><div><a href=/u>bo</a></div><p>Good news for once.</p></li><li><div><a href=/u>cy</a></div><p>Is there honey for sale?</p></li></ol><div class="f">2019 bluepage</div></body></html>""", "Why the bees came back Ten years ago there was not a single hive in the valley. Farmers stopped spraying, and the lime trees along the road grew old enough to bloom. Now there are four hundred hives."),
    ("""<html lang=sv><body><div class="meny"><a href=/>Hem</a> <a href=/v>Väder</a> <a href=/s>Sport</a></div><main><h1>Färjan går igen</h1><p>Efter en lång vinter går färjan igen sedan i måndags.</p><p>Biljetter köps ombord. Cyklar åker gratis.</p></main><div class="annons"><p>Köp ny cykel hos oss!</p></div><div class="sidfot"><p>Ansvarig utgivare</p></div></body></html>""", "Färjan går igen Efter en lång vinter går färjan igen sedan i måndags. Biljetter köps ombord. Cyklar åker gratis."),
    ("""<html><body><header><nav><a href=/>Docs</a> <a href=/api>API</a></nav></header><div class="docs"><h1>Reading files</h1><p>Open a file with the read function.</p><pre>x = read("a.txt")</pre><p>The function returns text. For bytes, pass a second argument.</p><dl><dt>path</dt><dd>Where the file lies.</dd><dt>mode</dt><dd>Text or bytes.</dd></dl></div><div class="prevnext"><a href=/p>Previous: Basics</a> <a href=/n>Next: Writing</a></div></body></html>""", "Reading files Open a file with the read function. x = read(\"a.txt\") The function returns text. For bytes, pass a second argument. path Where the file lies. mode Text or bytes."),
    ("""<html lang=tr><body><ul><li><a href=/>Ana sayfa</a><li><a href=/g>Gündem</a><li><a href=/h>Hava</a><li><a href=/i>İletişim</a></ul><section><h1>Köprü trafiğe açıldı</h1><p>Yeni köprü dün sabah trafiğe açıldı. Geçiş ilk hafta ücretsiz olacak.</p><p>Yapımı üç yıl sürdü.</p></section><section><h2>Yorumlar</h2><div><b>Ali</b><p>Hayırlı olsun hepimize.</p></div><div><b>Ece</b><p>Çok bekledik ama değdi.</p></div></section></body></html>""", "Köprü trafiğe açıldı Yeni köprü dün sabah trafiğe açıldı. Geçiş ilk hafta ücretsiz olacak. Yapımı üç yıl sürdü."),
    ("""<html><body><div><h2>Sign in</h2><form><p>Enter your name and password.</p><input></form></div><article><h1>A short walk</h1><p>Start at the church and follow the brook for a mile.</p><p>Cross at the mill, and come back on the other side.</p></article><section><h3>More walks</h3><ul><li><a href=1>The long walk</a></li><li><a href=2>The hill walk</a></li><li><a href=3>The lake walk</a></li></ul></section></body></html>""", "A short walk Start at the church and follow the brook for a mile. Cross at the mill, and come back on the other side."),
]
