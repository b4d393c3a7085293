"""Hand-written landed pages that the source, cleaning and job tests share."""

import json

EVENT = {
    "uid": 10,
    "title": " Concert ",
    "description": "<p>Bon&nbsp;jour *tous*</p>",
    "longDescription": "a\n\n-----\nb",
    "keywords": ["jazz", " piano ", ""],
    "dateRange": "1 - 2 juin",
    "createdAt": "2024-01-01T00:00:00.000Z",
    "updatedAt": "2024-05-01T12:00:00+02:00",
    "timings": [{"begin": "2024-06-01T20:00:00+02:00", "end": "2024-06-01T22:00:00+02:00"}],
    "firstTiming": {"begin": "2024-06-01T20:00:00+02:00"},
    "lastTiming": {"end": "2024-06-01T22:00:00+02:00"},
    "image": {"base": "https://img/", "filename": "f.jpg", "variants": [{"type": "full", "filename": "full.jpg"}]},
    "attendanceMode": 1,
    "status": 6,
    "registration": [{"type": "phone", "value": "05"}],
    "location": {
        "name": "Salle", "address": "1 rue", "city": "Castres", "postalCode": "31000", "department": "Alto Garona",
        "region": " OCCITANIE", "latitude": 43.6, "longitude": 1, "description": {"en": "Hall", "fr": ""},
        "access": "Métro", "phone": "", "website": "https://s", "image": "i.png",
    },
    "age": {"min": 0, "max": 99},
    "accessibility": {"vi": True, "hi": False, "mi": 1},
    "conditions": "<b>Gratuit</b>",
    "billetterie": "missing value",
    "links": [{"link": "https://l", "data": {"title": "T", "provider_name": "P", "x": 1}}, {"link": "https://k", "data": "text"}],
    "slug": "not kept",
}
OLDER = {
    "uid": 10,
    "title": "Old",
    "description": "old",
    "keywords": ["jazz", "soul"],
    "updatedAt": "2024-05-01T09:59:59Z",
    "conditions": "Payant",
    "nextTiming": {"begin": "2024-06-01T20:00:00+02:00", "end": "bad"},
    "location": {"email": "s@s", "phone": "06"},
    "accessibility": {"hi": True},
    "billetterie": "https://b",
}
OTHER = {
    "uid": "11",
    "title": "Expo",
    "updatedAt": "yesterday",
    "keywords": "solo",
    "image": " https://img/x.png ",
    "attendanceMode": 7,
    "timings": [{"begin": "2020-06-01T20:00:00+02:00"}],
    "lastTiming": {"end": "2020-06-01T22:00:00+02:00"},
    "location": {"city": "Albi", "region": "Bretagne"},
}
BROKEN_OWNER = {"uid": 12, "title": "Lost with its agenda"}


def write_landing(root):
    """Agenda listing of two pages; event pages of four agendas, one of them unreadable."""
    listing, events = root / "agendas", root / "events"
    listing.mkdir(parents=True)
    pages = [
        {"page": 0, "agendas": [{"uid": 1, "title": "Un"}, {"uid": "b c"}], "after": ["x", 1]},
        {"page": 1, "agendas": [{"uid": 3, "title": "Trois"}, {"uid": 4, "title": "Quatre"}]},
        {"page": 2},
    ]
    (listing / "part-0.json").write_text("\n".join(map(json.dumps, pages)))

    def land(folder, *lines):
        path = events / folder
        path.mkdir(parents=True)
        (path / "pages.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    land("agenda_uid=1", {"page": 0, "events": [EVENT], "after": "c"}, {"page": 1, "events": []}, {"page": 2})
    land("agenda_uid=b%20c", {"page": 0, "events": [OLDER, OTHER]})
    land("agenda_uid=3", {"page": 0, "events": [BROKEN_OWNER]}, '{"page": 1, "events": [{"uid": 13,')
    land("loose", {"agenda_uid": 4, "page": 0, "events": [{"uid": 14, "title": "Loose", "location": [], "age": "bad"}]})
    return str(listing), str(events)
