"""Pages written and labelled by hand, kept out of all training: layouts without an ``article``, and with names that tell nothing.

A block of main text begins with the sign ``§``, which is taken away before a page is used.
"""

PAGES = [
    # a news site whose names are made by a style compiler
    """<html><body><div class="x1a"><a href="/">Home</a> <a href="/w">World</a> <a href="/s">Sport</a> <a href="/m">Money</a></div><div class="k9"><h1>§Harbour bridge to close for repairs next spring</h1><div class="q3">§The city's oldest bridge will be shut to traffic for eleven weeks, the council decided on Tuesday evening.</div>
    <div class="q3">§Engineers found corrosion in four of the main cables during an inspection last autumn, and a second survey confirmed it.</div><div class="q3">§Buses will be sent over the northern crossing, while cyclists may use the railway bridge until nine at night.</div></div><div class="z7"><a href="/1">Ferry prices up</a><a href="/2">New stadium plan</a><a href="/3">Weather</a></div><div class="z8">© 2019 Harbour Press. All rights reserved.</div></body></html>""",
    # tables of the nineties
    """<table width="760"><tr><td colspan="2"><b>Bob's Model Railways</b></td></tr><tr><td width="150"><a href="a.htm">Main page</a><br><a href="b.htm">Engines</a><br><a href="c.htm">Guest book</a><br><a href="d.htm">Links</a></td><td><p>§Welcome to the third part of my series on building a small branch line in the attic of an ordinary house.
    <p>§This time we lay the track bed, which has to be level to within a millimetre or the longer coaches will come off in the curves.<p>§I used cork sheets of five millimetres, glued down in strips, and sanded the joints once everything had dried overnight.</td></tr><tr><td colspan="2">Last changed 4 May 1998. You are visitor 10482.</td></tr></table>""",
    # a recipe
    """<body><ul><li><a href="/soups">Soups</a></li><li><a href="/mains">Mains</a></li><li><a href="/cakes">Cakes</a></li></ul><section><h1>§Lentil soup with lemon</h1><p>§A bowl of this soup is ready in half an hour and tastes even better when it is warmed up again the next day.</p><h2>§Method</h2><ol><li>§Soften the onions slowly in olive oil until they turn gold, which takes about ten minutes on a low flame.</li>
    <li>§Add the lentils and the stock, bring everything to the boil, and let it simmer under a lid until soft.</li><li>§Season with salt, cumin and the juice of a whole lemon just before the soup is served.</li></ol></section><div><a href="/1">Print</a> <a href="/2">Save</a> <a href="/3">Share</a></div><div>Sign up for our weekly mail</div></body>""",
    # a blog in one column of bare divs
    """<div><a href="/">about</a> | <a href="/archive">archive</a> | <a href="/feed">feed</a></div><div><h2>§On keeping a paper notebook</h2><p>§For almost four years I have written everything that I wanted to remember into small grey notebooks of ninety-six pages.</p><p>§The habit began on a train without a network, and it stayed because nothing ever needed to be charged or updated.</p>
    <p>§What surprised me most is how often I find a line again simply because I remember where on a page it stood.</p></div><div><p>Posted in <a href="/t/1">habits</a>, <a href="/t/2">paper</a></p></div><div><a href="/p">Older</a> <a href="/n">Newer</a></div>""",
    # documentation with a long list of links on the left
    """<div id="l"><ul><li><a href="#">Install</a></li><li><a href="#">Configure</a></li><li><a href="#">Commands</a></li><li><a href="#">Errors</a></li><li><a href="#">Licence</a></li></ul></div><div id="r"><h1>§Configuring the scheduler</h1><p>§The scheduler reads its settings once at start and again whenever it receives a hang-up signal from the operating system.</p>
    <p>§Each job has a name, a time pattern and a command; jobs with the same name replace each other in the order of the files.</p><pre>§job backup at 02:30 run /usr/bin/backup --all</pre><p>§If a command is still running when its next start is due, that start is left out and a warning goes to the log.</p></div><div id="b"><a href="#">Previous</a><a href="#">Next</a></div>""",
    # a company's press release
    """<header><a href="/">Products</a><a href="/">Careers</a><a href="/">Investors</a></header><div class="row"><div class="col-8"><h1>§Northwind opens a second turbine plant in Aarhus</h1><p>§Northwind today opened a plant for offshore turbines that will employ three hundred and forty people by the end of the year.</p><p>§The building was finished two months ahead of plan, and the first blades are to be delivered to a wind park in October.</p>
    <p>§"We have waited for this day for a long time," said the head of production at the opening on Friday morning.</p></div><div class="col-4"><p>Press contact</p><p>Tel. 555 0134</p><p><a href="/kit">Media kit</a></p></div></div><footer><p>Imprint | Privacy | Terms of use</p></footer>""",
    # a forum's first post, whose answers are comments
    """<div class="top"><a href="/f">Forum</a> &gt; <a href="/f/7">Gardening</a></div><div class="post"><h1>§Why do my tomatoes split?</h1><p>§Every August the fruits on my balcony crack open within a few days, although I water them each evening without fail.</p><p>§The pots hold about ten litres, they stand against a south wall, and I feed them once a week with a liquid fertiliser.</p></div>
    <div class="comments"><div class="comment"><p>Same here, it was the heavy rain in my case.</p></div><div class="comment"><p>Try mulch, it keeps the soil evenly moist and mine never split since.</p></div></div><div class="bottom">Powered by BoardThing 2.1</div>""",
    # text broken by line breaks alone
    """<body bgcolor=white><a href=index.html>Back</a><hr><h3>§The lighthouse keeper's winter</h3>§When the first storm of November came over the point, the keeper had already carried six weeks of oil up the tower stairs.<br><br>§He wrote in his log that the spray had reached the gallery, which had not happened since the great flood of his childhood.<br><br>§On the ninth day the supply boat could be seen from the lamp room, but it turned round before it had passed the bar.<hr><a href=next.html>Next story</a></body>""",
    # questions and answers in a definition list
    """<nav><a href="/">Start</a><a href="/help">Help</a></nav><div><h1>§Questions about returning goods</h1><dl><dt>§How long may I keep an item before I send it back?</dt><dd>§You may return anything within thirty days of the day on which it reached you, as long as it hasn't been worn.</dd><dt>§Who pays for the parcel?</dt><dd>§We do, if you use the label that lies in every box; other parcels have to be paid for by the sender.</dd></dl></div>
    <div><form><label>Search help</label><input></form></div><div>Need more? <a href="/c">Contact us</a></div>""",
    # an encyclopedia
    """<div id="n"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></div><div id="c"><h1>§Salt marsh</h1><p>§A salt marsh is a piece of flat coast between land and open sea that is flooded by the tides at regular intervals.</p><h2>§Plants</h2><p>§Only a few dozen species bear the salt; they form belts, one above the other, by how often each height is under water.</p>
    <p>§The lowest belt is held by glasswort, whose fleshy stems turn red in autumn and can be eaten like a vegetable.</p></div><div id="f"><ul><li>This page was last edited on 3 March.</li><li><a href="/p">Privacy</a></li></ul></div>""",
    # a magazine with a notice about cookies and an advert in the text
    """<div class="cookie">We use cookies to make this site work. <a href="#">Accept</a></div><div class="wrapper"><h1>§The quiet return of the night train</h1><p>§Ten years ago hardly anyone believed that sleeping cars would ever be ordered again, least of all the railways themselves.</p><div class="advert"><p>Fly to Lisbon from 49 euros. Book now!</p></div>
    <p>§Today four companies run beds across the Alps, and the cheapest cabins are sold out months before the summer begins.</p><p>§Much of that has to do with new rules for luggage, but more with people who simply want to arrive in the morning.</p></div><div class="newsletter"><p>Get our best stories every Saturday.</p></div>""",
    # a shop's page of a product
    """<div><a href="/">Shop</a><a href="/tents">Tents</a><a href="/cart">Cart (0)</a></div><div><h1>§Ridge tent for two</h1><p>§This tent weighs less than two kilograms and can be put up by one person in under five minutes, even in wind.</p><p>§Its outer cloth is coated on both sides and keeps out a water column of three metres, tested after twenty washes.</p></div><div><button>Add to cart</button> <span>In stock</span></div>
    <div><p>Others bought</p><ul><li><a href="/1">Stove</a></li><li><a href="/2">Lamp</a></li><li><a href="/3">Mat</a></li></ul></div>""",
    # German, with umlauts as character references
    """<body><div class="navi"><a href="/">Startseite</a> <a href="/k">Kontakt</a></div><div class="inhalt"><h1>§Der Wald im Klimawandel</h1><p>§In den letzten f&uuml;nf Jahren sind im Mittelgebirge mehr Fichten abgestorben als in den drei&szlig;ig Jahren davor zusammen.</p><p>§F&ouml;rster setzen nun auf Mischw&auml;lder, weil verschiedene Baumarten auf Trockenheit sehr unterschiedlich reagieren.</p></div><div class="fuss">Impressum &middot; Datenschutz</div></body>""",
    # French, with one main element among sections
    """<div><ul><li><a href="/">Accueil</a></li><li><a href="/r">R&eacute;gions</a></li></ul></div><section><h2>§Le marché du samedi renaît</h2><p>§Depuis le mois de mars, une quarantaine de producteurs s'installent de nouveau chaque samedi sur la place de la mairie.</p><p>§Les habitants avaient signé une pétition après la fermeture de la dernière épicerie du village, il y a trois ans.</p></section><section><h3>À lire aussi</h3><a href="/1">Le train de nuit</a><a href="/2">La moisson</a></section><div>Mentions légales</div>""",
    # Spanish, text in table cells beside a column of links
    """<table><tr><td><a href="/1">Inicio</a><a href="/2">Noticias</a><a href="/3">Agenda</a></td><td><h1>§La biblioteca abre también los domingos</h1><p>§A partir de septiembre la biblioteca municipal abrirá sus puertas todos los domingos desde las diez hasta las catorce horas.</p><p>§La medida, que pedían sobre todo los estudiantes, se probará durante un año y después se decidirá si continúa.</p></td></tr></table><p>Aviso legal</p>""",
    # a long sidebar before a short text
    """<div class="c1"><p>Tags</p><a href="/a">light</a><a href="/b">film</a><a href="/c">travel</a><a href="/d">people</a><p>Archive</p><a href="/e">May</a><a href="/f">June</a><a href="/g">July</a></div><div class="c2"><h2>§Winter light on the estuary</h2><p>§Three mornings in a row the fog lay so low over the water that only the tops of the masts could be seen from the road.</p></div><div class="c3">Theme by somebody</div>""",
    # a letter of an association, headings in bold paragraphs
    """<div class="kopf"><p>Rowing Club of 1887</p><p><a href="/t">Dates</a> <a href="/b">Boats</a></p></div><div class="mitte"><p><b>§Report on the autumn regatta</b></p><p>§Forty-two crews from nine clubs came to our regatta on the lower river, more than in any year since the new boathouse was built.</p><p>§Our juniors won both their races against crews that were, on average, a full year older and a good deal heavier.</p></div><div class="ende"><p>Members only: <a href="/login">log in</a></p></div>""",
    # a government page with an alert and a form
    """<div role="alert">This service will be down on Sunday from 1 to 3 am.</div><div class="g-w"><h1>§Register a change of address</h1><p>§You have to tell the office about your new address within two weeks of moving, whether you rent the flat or own it.</p><p>§Bring your identity card and the form that your landlord has signed; children can be registered together with you.</p></div><form><label>Was this page helpful?</label><button>Yes</button><button>No</button></form><div>Crown copyright</div>""",
    # a science piece with a caption
    """<div class="m"><a href="/">Topics</a><a href="/">Podcasts</a><a href="/">Subscribe</a></div><div class="t"><h1>§Bees count the corners of flowers</h1><p>§Bumblebees trained on artificial flowers learned within a day to tell five petals from six, a study in three meadows shows.</p><figure><img src="b.jpg"><figcaption>§A bumblebee of the trained colony on one of the artificial flowers.</figcaption></figure>
    <p>§The insects kept the skill over a week, although they had met no artificial flower in the meantime, the authors write.</p></div><div class="s"><a href="/x">Tweet</a><a href="/y">Mail</a></div>""",
    # lists as the main text
    """<div><a href="/">All checklists</a></div><div><h1>§Before you leave a boat for the winter</h1><ul><li>§Close all sea valves and write down which of them were stiff, so that they can be taken apart in spring.</li><li>§Drain the water tank and the pump, because a single night of frost is enough to crack the housing.</li><li>§Take home every cushion and everything made of cloth; what stays on board will smell of damp by March.</li></ul></div><div>Copyright Marina South</div>""",
    # a page of links only
    """<div><ul><li><a href="/1">Home</a></li><li><a href="/2">Galleries</a></li><li><a href="/3">Impressum</a></li></ul></div><div><a href="/4">Part one</a><a href="/5">Part two</a></div><div>© 2003</div>""",
    # an interview
    """<div class="h"><a href="/">Issue 14</a><a href="/s">Shop</a></div><div class="i"><h1>§"I repair what others throw away"</h1><p>§For thirty years she has mended watches in a shop that is barely wider than its own door; we visited her at work.</p><p><b>§Do you ever give up on a watch?</b></p><p>§Hardly ever. When a part can't be bought any more I make it, and when I can't make it I wait until one turns up.</p></div><div class="j">Read next: <a href="/9">The last cooper</a></div>""",
    # quotes and a source
    """<div><a href="/">Reviews</a><a href="/b">Books</a></div><div><h2>§A novel about a ferry that never leaves</h2><p>§The book begins with a storm, and for two hundred pages the storm is all that happens, which is a good deal more than it sounds.</p><blockquote>§We had all bought tickets, and none of us had ever asked where the boat was going.</blockquote><p>§It is this sentence that the whole story turns round, without the author ever coming back to it openly.</p></div><div><p>Rate this: <a href="#">1</a> <a href="#">2</a> <a href="#">3</a></p></div>""",
    # a text between two adverts, unclosed elements
    """<div class=ad>Win a car today<div class=b><a href=/>Top</a></div><div class=u><h1>§How the canal got its second lock<p>§The first lock had been built so narrow that barges with a full load had to wait for the tide twice on every journey.<p>§In 1871 the owners gave in, and a second chamber was dug beside the old one by two hundred men in a single summer.</div><div class=ad>Cheap insurance, call now</div><div class=v>Webmaster: J. Smith</div>""",
]


def labelled() -> list[tuple[str, list[str]]]:
    """Pages without the sign, and those with it for telling the labels of their blocks."""
    return [(p.replace("§", ""), p) for p in PAGES]
